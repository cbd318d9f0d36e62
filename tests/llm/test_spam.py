import random
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm.spam import _TOKEN, _Classes, fit, fit_texts, label_lines, label_pages, load, read_lines, save, shipped, spam_pages

SPAM = [
    "buy sun hat, cheap sun hat, sun hat best price, discount sun hat, wholesale sun hat, sun hat online",
    "\n".join(f"https://shop{i}.example/p?id={i}" for i in range(9)),
    "<a href=\"http://a-b.test/x\">Kaz</a><br>" * 8,
    "- more on the hat\n  https://a-b.test/x\n" * 6,
    "#sunhat #cheap #best #yoga-mat #deal " * 4,
    "Home > Sale > Pet Bowl > Kaz\nHome > New > Yoga Mat > Rip\n" * 5,
    "The tool box is the tool box for all who want a tool box. A tool box is not just a tool box, it is your tool box. " * 4,
    "Rip wool scarf S mint SKU 67477\nKaz yoga mat XL red EAN 12345678\n" * 5,
    "b@r@to b0ls@ ch3ap w00l.scarf.sale buy​hat woolscarfdiscount " * 4,
    "Tag: Kaz, sale, sun hat\nBrand: Rip, deal\n" * 5,
]
HONEST = [
    "We sell hats. The sun hat comes with a short guide that explains how to clean it. You can return it within 14 days.",
    "3 x sun hat  19.90 EUR\n1 x tool box  5.00 EUR\n" * 6,
    "Mon 09:00-17:30 desk A, extension 123\nTue 08:00-12:30 desk B, extension 456\n" * 5,
    "12:00:01.123 INFO worker-1 committed offset 4711\n12:00:02.456 WARN worker-2 retrying insert, attempt 3\n" * 5,
    '{"rule_id": "R001", "observed": 4, "matched": true}\n' * 6,
    "1. Write down the offset at which you stopped, because the next shift needs it.\n2. Stop the worker before you replay the range.\n" * 3,
    "Chargeback: a payment that the bank takes back after the customer has disputed it.\nAcquirer: the bank that settles the card payments of a shop.\n" * 2,
    "Q: Why was my payment for the hat held?\nA: It was stopped as the address had changed.\n" * 4,
    "Der Händler erwähnte den offenen Betrag, und niemand widersprach. Mehr dazu steht unter https://shop.example/hilfe und bei #service im Forum.",
    "ok", "n/a", "see above",
]


def test_kinds_of_pages(spark):
    rows = [(i, t) for i, t in enumerate(SPAM)] + [(100 + i, t) for i, t in enumerate(HONEST)]
    got = {r.doc_id for r in spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(len(SPAM)))


def test_every_character_has_a_label_and_dirty_rows_pass(spark):
    rows = [(1, None, 1), (2, "", 2), (2, " \n\t ", 3), (None, "x" * 2_000_000, 4), (5, "buy hat " * 200_000, 5), (6, "​<\n[](", 6), (7, "a\r\nb. c!", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prose int")
    got = label_pages(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.chars for r in got) == sorted(len(t or "") for _, t, _ in rows)
    assert all(r.chars == r.prose + r["links"] + r.tags + r["menu"] + r.records for r in got)
    assert label_pages(df.limit(0)).count() == 0


def test_labels_do_not_depend_on_the_pages_around(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {tuple(r) for r in label_pages(docs.coalesce(1)).collect()}
    many = {tuple(r) for r in label_pages(docs.repartition(7)).collect()}
    assert one == many


# The spam among the 1,000 pages of sf0.01, found by reading; none of them was in the sample of the model
READ = (
    44, 45, 57, 65, 68, 69, 104, 114, 144, 151, 156, 161, 163, 186, 230, 240, 288, 294, 299, 312, 322, 328, 345, 365, 372, 417, 422, 436, 443, 467,
    474, 483, 487, 489, 495, 497, 503, 533, 558, 596, 631, 659, 685, 731, 772, 779, 783, 786, 832, 891, 909, 933, 936, 940, 952, 971, 972, 996,
)


def test_held_out_pages(spark):
    got = {r.doc_id for r in spam_pages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    both = len(got & set(READ))
    assert both / len(got) >= 0.98 and both / len(READ) >= 0.98


def test_a_model_is_fitted_on_marked_pages_only(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("doc_id").isin(*READ).alias("spam"))
    m = fit(docs.where("doc_id % 2 = 0 OR text IS NULL"), rounds=3)
    assert np.allclose(np.exp(m.begin).sum(), 1) and np.allclose(np.exp(m.move).sum(axis=1), 1)
    rest = {d for d in READ if d % 2}
    got = {r.doc_id for r in spam_pages(docs.where("doc_id % 2 = 1"), m).collect()}
    assert len(got & rest) >= 0.6 * len(rest) and len(got - rest) <= 2  # 25 spam pages are few to learn from
    save(m, tmp_path / "m.npz")
    kept, x = load(tmp_path / "m.npz"), read_lines([r.text or "" for r in docs.where("doc_id < 200").collect()], _Classes())
    assert (label_lines(x, m) == label_lines(x, kept)).mean() > 0.999
    assert len(fit(docs, most=10, rounds=1).begin) == 5 and fit_texts(["", "a b"], np.array([True, False]), 1).known.sum() == 2


def test_long_lines_are_cut_into_pieces():
    x = read_lines(["word " * 100, "", "a. b.", "https://a-b.test/x " * 40], _Classes())
    assert np.bincount(x.page).tolist() == [7, 0, 2, 10] and x.units.sum() == 142 and shipped().known.any()


def prose(n, rng):
    """n honest sentences, of words that hardly repeat."""
    noun = lambda: "".join(rng.choice(["ba", "ne", "lo", "mi", "ter", "san", "gol", "ru"]) for _ in range(3))
    return " ".join(f"The {noun()} of the {noun()} was not what they had {noun()}, so we {noun()} it with a {noun()} before the {noun()} came." for _ in range(n))


def test_markup_of_any_length(spark):
    rng = random.Random(3)
    spam = ["\n".join(f'<a href="https://a-b.test/x{i}" title="{prose(n, rng)}">Kaz</a>' for i in range(4)) for n in (1, 9, 300)]
    spam += ["\n".join(f"[{prose(n, rng)}](https://a-b.test/{'x' * k}{i})" for i in range(4)) for n, k in ((1, 9), (9, 9), (300, 9), (9, 20_000))]
    honest = [f"The fee is < 5 EUR. {prose(40, rng)} The total is > 9 EUR.", f"Here x <b and [c. {prose(40, rng)} Then c] and b> y."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(spam + honest)], "doc_id long, text string")
    assert {r.doc_id for r in spam_pages(df).collect()} == set(range(len(spam)))


def test_unclosed_markup_is_read_in_one_pass(spark):
    texts = ["<" * 400_000, "[" * 400_000, "<a " * 200_000, "[x](y" * 100_000, "<a " + "b " * 400_000, "[" + "b " * 400_000]
    start = time.monotonic()
    assert all("".join(_TOKEN(t)) == t for t in texts)
    assert time.monotonic() - start < 10
