"""Noise by pieces: what a task holds does not grow with its batches."""

import pyarrow as pa

from textward.operators import augment


def test_noise_by_pieces():
    """A batch of any length leaves in pieces, each made when it is asked for; other columns come through."""
    n = 2 * augment.PIECE + 1
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["some words here"] * (n - 1) + [""], "_x": [0.1] * n, "_draw": list(range(n))})
    taken = iter([batch])
    made = augment._noisy("replace", ["doc_id"], augment.LATIN, augment.SHARES)(taken)
    pieces = list(made)
    assert [p.num_rows for p in pieces] == [augment.PIECE, augment.PIECE, 1]
    assert [x for p in pieces for x in p.column("doc_id").to_pylist()] == list(range(n))
    assert pieces[-1].to_pylist()[0] == {"doc_id": n - 1, "text": "", "kind": "original"} and pieces[0].to_pylist()[0]["kind"] == "char_noise_replace"
