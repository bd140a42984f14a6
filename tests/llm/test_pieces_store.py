"""What sampling keeps from slice to slice, and words that the library gets together."""

import sys
from pathlib import Path

import numpy as np
import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sparkloom.llm import pieces  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def drawn_of(texts, known, store=None):
    drawn = pieces.Samples(pieces.Lattice(texts, known, store), np.arange(1, len(texts) + 1, dtype=np.uint64), 3)
    return [drawn.ids(r)[0].tolist() for r in range(3)], drawn.log_p


def test_store_keeps_words_used_again_and_is_small():
    known, store = pieces.vocabulary(PIECES, 1.0), pieces.Store()
    often, once = "the été 你好 cat   x", [f"w{i}q{i * 7}" for i in range(3000)]
    pieces.Lattice([often, often, " ".join(once), often], known, store)
    assert sum(store.get(name).nbytes for name in store.arrays if name != "pool") < 100 * store.chars
    want = drawn_of([often, "été w7q49", "zzz"], known)
    for most, held in ((1000, 5), (8, 2), (0, 0)):
        store.shrink(most, known.n_ids)
        assert store.chars <= most and len(store.get("start")) == len(store.hashes) <= held
        assert (len(store.hashes) == 5) == (most == 1000)
        found = drawn_of([often, "été w7q49", "zzz"], known, store)
        assert found[0] == want[0] and np.allclose(found[1], want[1])


def test_words_of_a_slice_encode_alone_as_together():
    known = pieces.vocabulary(PIECES, 1.0)
    words = ["▁", "▁the", "▁▁", "▁", "▁你", "▁▁▁in", "▁\x00\t", "▁😀é", "▁a​", *(f"▁n{i}" for i in range(100)), "▁"]
    ids, n = known.encode(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array(list(map(len, words))))
    alone = [known.model.encode(w[1:].replace("▁", " ")) or known.lone_mark.tolist() for w in words]
    assert n.tolist() == list(map(len, alone)) and ids.tolist() == [i for a in alone for i in a]
