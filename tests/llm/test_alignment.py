"""Alignment of two tokenizers, against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from corvane.llm import alignment

ROWS = [
    (1, "one two three, and a longer word: incomprehensibilities"),
    (2, None),
    (3, ""),
    (None, "no id here"),
    (1, "one two three, and a longer word: incomprehensibilities"),
    (4, "  spaces   and\ttabs\n\n and <s> <|endoftext|> </s> <unk> <0x41>"),
    (5, "é ü 漢字 \U0001f600\x00 ́x"),
    (6, "holds ▁ itself"),
    (7, "word and more, naïve 12345. " * 2000),
    (8, " "),
]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    letters = {c: i for i, c in enumerate(_letters())}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        of_x = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        of_y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if b"".join(of_x) != whole or b"".join(of_y) != whole:
            x, y = [], []
            of_x, of_y = [], []
        ends_x, ends_y = np.cumsum([len(t) for t in of_x]).tolist(), np.cumsum([len(t) for t in of_y]).tolist()
        common = sorted(set(ends_x) & set(ends_y))
        links = [(y[ends_y.index(e)], x[ends_x.index(e)]) for e in common]
        counts.update(links)
        groups, at = [], 0
        for e in common:
            groups.append(",".join(str(i) for i, z in zip(x, ends_x, strict=True) if at < z <= e) + "|" + ",".join(str(i) for i, z in zip(y, ends_y, strict=True) if at < z <= e)) if len(x) < 400 else None
            at = e
        digest = None if len(x) >= 400 else hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        docs.append((doc_id, len(x), len(y), links, digest))
    top = {}
    for (q, _), n in counts.items():
        top[q] = max(top.get(q, 0), n)
    return [(d, n_a, n_b, len(l), len(l), sum(counts[k] == top[k[0]] for k in l), sum(counts[k] for k in l), h) for d, n_a, n_b, l, h in docs], counts


def _letters():
    """The byte-level alphabet in order of bytes: printable ones stand for themselves, the others are numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [], 0
    for i in range(256):
        out.append(chr(i) if i in own else chr(256 + n))
        n += i not in own
    assert set(out) == set(ByteLevel and __import__("tokenizers").pre_tokenizers.ByteLevel.alphabet())
    return out


def check(got, want):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert all(w[-1] is None or g[-1] == w[-1] for g, w in zip(got, want, strict=True))


def test_equals_the_plain_version(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], "doc_id long, text string, n_a long, links string, n long").repartition(3)
    check(alignment.score(docs).collect(), plain(ROWS)[0])


def test_small_pieces_of_work_give_the_same(spark, monkeypatch):
    """Many partial counts, shards and slices; each partition of the tasks' own modules is patched through a closure."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(alignment, "SHARD_COUNTS", 20)
    shards = alignment.pair_counts(alignment.align(docs))
    assert shards.count() > 3
    want = plain(ROWS)[1]
    table = alignment.pair_table(shards).collect()
    assert {(r.b, r.a): r.n for r in table} == dict(want) and len(table) == len(want)
    check(alignment.score(docs).collect(), plain(ROWS)[0])


def batches(keys, counts, size):
    for at in range(0, len(keys), size):
        yield pa.record_batch([pa.array(keys[at : at + size]), pa.array(counts[at : at + size])], ["key", "n"])


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_runs_go_on_over_batches(tmp_path, size):
    r = np.random.default_rng(3)
    keys = np.sort((r.integers(0, 4, 200) << 32) | r.integers(0, 9, 200))
    counts = r.integers(1, 5, 200)
    (row,) = alignment._shards(str(tmp_path))(batches(keys, counts, size))
    path, first, n = (row.column(c)[0].as_py() for c in ("path", "first", "n"))
    want = Counter()
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        want[k] += c
    assert alignment.mapped(path + ".keys").tolist() == sorted(want) and first == min(want) and n == len(want)
    assert alignment.mapped(path + ".counts").tolist() == [want[k] for k in sorted(want)]
    top = {}
    for k, c in want.items():
        top[k >> 32] = max(top.get(k >> 32, 0), c)
    assert dict(zip(row.column("ids")[0].as_py(), row.column("tops")[0].as_py(), strict=True)) == top
    assert len(row.column("ids")[0]) == len(top)


def test_partial_counts_are_handed_on_when_they_are_many(monkeypatch):
    monkeypatch.setattr(alignment, "SORTED_KEYS", 7)
    monkeypatch.setattr(alignment, "KEPT_COUNTS", 10)
    keys = np.random.default_rng(4).integers(0, 60, 500)
    rows = list(alignment._partial([pa.record_batch([pa.array([keys[:300].tolist(), [], None, keys[300:].tolist()], pa.list_(pa.int64()))], ["links"])]))
    assert len(rows) > 3
    got = Counter()
    for row in rows:
        for k, n in zip(row.column("key").to_pylist(), row.column("n").to_pylist(), strict=True):
            got[k] += n
    assert got == Counter(keys.tolist())


def test_shards_in_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "_local", lambda path: None)
    (row,) = alignment._shards(f"file://{tmp_path}/x y")(batches(np.array([1, 1, 2]), np.array([3, 4, 5]), 2))
    path = row.column("path")[0].as_py()
    assert alignment.mapped(path + ".keys").tolist() == [1, 2] and alignment.mapped(path + ".counts").tolist() == [7, 5]


def test_no_documents(spark):
    assert alignment.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = alignment.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(alignment.score(docs).collect(), plain([(r.doc_id, r.text) for r in docs.collect()])[0])
