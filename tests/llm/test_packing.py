import collections
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import packing


def bins_of(lengths, capacity):
    """One piece at a time, by search over all open bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            r, i = min(fit)
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, 20), max_size=80))
@settings(deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    used, seen = collections.Counter(), collections.Counter()
    for length, rank, pieces, first, per, offset in packing.plan(collections.Counter(lengths), 20):
        assert rank == seen[length]
        seen[length] += pieces
        for k in range(pieces):
            b = first + k // per
            assert used[b] == offset + k % per * length
            used[b] += length
    assert seen == collections.Counter(lengths)
    assert sorted(20 - n for n in used.values()) == bins_of(lengths, 20)


def test_tree_finds_the_tightest():
    r = random.Random(2)
    tree, rooms = packing.CapacityTree(50), collections.Counter()
    for _ in range(500):
        room = r.randint(0, 50)
        tree.add(room, 1)
        rooms[room] += 1
        if r.random() < 0.6:
            gone = r.choice([k for k in rooms if rooms[k]])
            tree.add(gone, -1)
            rooms[gone] -= 1
        need = r.randint(1, 50)
        assert tree.tightest(need) == min((k for k in rooms if rooms[k] and k >= need), default=None)


def test_pieces_tile_documents_and_sequences(spark):
    r = random.Random(4)
    make = lambda n: "".join(r.choice(["ab", " the", "  ", "\n", " é", "12", ".", " x", "\t", "don't", "\x1c", "　"]) for _ in range(n))
    rows = [(i, make(r.choice([0, 3, 50, 400, 3000]))) for i in range(60)] + [(100, None), (100, None), (None, "x"), (101, " a b "), (102, "a \n b"), (103, "<|endoftext|>")]
    rows += [(104 + i, make(3).join(["", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> a", "<|endoftext|"][:i + 2])) for i in range(5)]
    out = packing.pack(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, task int").repartition(3)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in out:
        pieces[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        if d == 100:
            assert [p["length"] for p in pieces[d]] == [1, 1]
            continue
        mine = sorted(pieces[d], key=lambda p: p["piece"])
        assert sum(p["length"] for p in mine) == len(ids) and [p["piece"] for p in mine] == list(range(len(mine)))
        assert all(p["length"] == 1024 for p in mine[1:])
        for p in mine:
            part = ids[p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) == len(bins_of([p["length"] for p in out], 1024))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
