"""Fits the model of `spam.shipped`: python -m ledgerlens.llm.fit_spam DOCUMENTS_PARQUET

spam_labels.txt has the doc_ids of the spam among PAGES pages of a table of 10,000 (the ones whose
doc_id has the least hash); the other pages of the sample are not spam. The labels were made by
reading: an earlier version of the labeller, with rules set by hand, proposed them, and all pages it
proposed and all in which it had found more than 8 % of such text among the first 3,000 were read.
"""

from __future__ import annotations

import sys
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from ledgerlens.llm import spam

PAGES = spam.SAMPLE
HERE = Path(__file__).parent


def sample(path: str) -> tuple[list[str], np.ndarray]:
    """Texts and marks of the labelled pages of a documents table."""
    marked = set(map(int, HERE.joinpath("spam_labels.txt").read_text().split()))
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    pages = sorted(zip(t["doc_id"], t["text"]), key=lambda r: (int(blake2b(str(r[0]).encode(), digest_size=4).hexdigest(), 16), r[0]))[:PAGES]
    return [x or "" for _, x in pages], np.array([d in marked for d, _ in pages], bool)


if __name__ == "__main__":
    spam.save(spam.fit_texts(*sample(sys.argv[1])), HERE / "spam_model.npz")
