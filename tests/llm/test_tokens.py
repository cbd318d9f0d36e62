import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import PATTERN, VOCABULARY, counter, token_count


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_tokenizer(reference):
    count = counter()
    texts = ["", " ", "\n\n  x", "don't  stop'll\t\n", "Größe: 12,5 €  – l'été d'hier", "a​b́ ١٢٣ ½ 你好", "😀 ok 👍🏽", "x" * 5000, "\x1c\x1d a\x85b  c", "end \n "]
    rng = random.Random(1)
    pool = "ab'sZ é \n\t.,!-19½²ⅷ_ßж中́​€\x1f 　"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert count(t) == len(reference.encode_ordinary(t)), repr(t)


def test_whole_table(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", token_count(F.col("text")).alias("n"))
    for text, n in df.collect():
        assert n == len(reference.encode_ordinary(text or ""))
