"""The training sample of the quality classifier."""
import numpy as np

from saddle.llm import quality


def test_repeated_rows_leave_the_sample_to_other_documents(rows, monkeypatch):
    ids = [i for i in range(60)]
    docs = rows("doc_id long, text string", [(i, f"text {i} copy {n}") for i in ids for n in range(30)])
    labels = rows("doc_id long, quality int", [(i, i % 2) for i in ids])
    monkeypatch.setattr(quality, "train", lambda texts, y, share: {"texts": texts, "y": y})
    got = quality.fit(docs, labels, sample=10)
    documents = [t.split()[1] for t in got["texts"]]
    assert len(documents) == len(set(documents)) == 20 and np.bincount(got["y"]).tolist() == [10, 10]
