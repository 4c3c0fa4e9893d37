"""Token alignment against whole-text encoding and plain overlaps of intervals."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rolesift.llm import token_alignment as ta
from rolesift.llm.queries import QUERIES
from tests.llm.test_llm_queries import SF_DIR, pytestmark  # noqa: F401

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def gpt_bytes():
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160) and b < 256 and not (127 <= b <= 160)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown and b != 173:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


@pytest.fixture(scope="module")
def tokenizers_of():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    symbol = gpt_bytes()

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(symbol[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)
        ]
        whole = (" " + text).encode()
        return ([], []) if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (
            list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))
        )

    return both


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts, both):
    rows, counts = [], Counter()
    for text in texts:
        a, b = map(spans, both(text)) if text else ([], [])
        links = [(x[0], y[0]) for x, y in overlaps(a, b)]
        counts.update(links)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for cut in cuts:
            inside = lambda tokens: ",".join(str(i) for i, s, e in tokens if low <= s and e <= cut)  # noqa: E731, B023
            groups.append(inside(a) + "|" + inside(b))
            low = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(cuts), links, sha))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, n_g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
        for n_a, n_b, n_g, links, sha in rows
    ]


def overlaps(a, b):
    """All pairs with a byte in common, found from every byte."""
    owner = {}
    for y in b:
        for at in range(y[1], y[2]):
            owner[at] = y
    return [(x, y) for x in a for y in sorted({owner[at] for at in range(x[1], x[2])}, key=lambda t: t[1])]


def found(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.orderBy("doc_id").collect()]


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "b", "Zü", "日本", " ", "  ", "\n", "\t", "'s", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "12", "\U0001f600", "é", "é", "\x00", "\x85", "\xa0", "​", "!!", "ﬁ", "the ", "\r\n", "\x1c", "　"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(300)]
    return [None, "", " ", "  ", "x", " x", "x ", "<|endoftext|>", "a▁b", *texts, "word soup " * 3_000, "x" * 3_000]


@pytest.mark.parametrize("table_pairs", [ta.TABLE_PAIRS, 40])
def test_odd_texts(spark, tokenizers_of, table_pairs):
    texts = odd_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(3)
    assert found(ta.align_tokens(docs, A_FILE, B_FILE, table_pairs=table_pairs)) == plain(texts, tokenizers_of)


def test_registered_query(spark, tokenizers_of):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    assert found(QUERIES["op11_token_alignment"](spark, SF_DIR)) == plain([t for _, t in rows], tokenizers_of)


def test_both_are_cut_into_words():
    for encoder in (ta.byte_level(open(A_FILE, "rb").read()), ta.sentence_pieces(open(B_FILE, "rb").read())):
        assert encoder.by_words


@pytest.mark.parametrize("piece", [1, 2, 7, 256])
def test_pieces_do_not_matter(piece, monkeypatch):
    rng = np.random.default_rng(piece)
    monkeypatch.setattr(ta, "BLOCK_PIECES", 5)
    for _ in range(30):
        a, b = (np.unique(np.append(rng.integers(1, 200, rng.integers(0, 90)), 200)) for _ in range(2))
        got = ta.align(a, b, piece)
        every = np.union1d(a, b)
        assert got.link_a.tolist() == np.searchsorted(a, every).tolist()
        assert got.link_b.tolist() == np.searchsorted(b, every).tolist()
        both = np.intersect1d(a, b)
        assert got.n_groups == len(both)
        assert got.group_a.tolist() == np.searchsorted(both, a).tolist()
        assert got.group_b.tolist() == np.searchsorted(both, b).tolist()


def test_repeated_rows_null_ids_and_empty_tables(spark, tokenizers_of):
    rows = [(1, "the same text"), (1, "the same text"), (None, "the same text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ta.align_tokens(docs, A_FILE, B_FILE).collect()
    assert sorted((repr(r.doc_id), *(r[c] for c in COLUMNS)) for r in out) == sorted(
        (repr(i), *p) for (i, _), p in zip(rows, plain([t for _, t in rows], tokenizers_of))
    )
    assert ta.align_tokens(docs.limit(0), A_FILE, B_FILE).isEmpty()


def test_words_are_compared_with_their_ids_all_at_once():
    """Words of the wrong length, of the right length with other bytes, and without ids among right ones."""
    entries = [b" a", b"b", b" ab", b" xy", b""]
    told = {"a": [0], "ab": [0, 1], "abb": [2, 1], "ba": [3], "b": [4], "": [], "abbb": [2, 1, 1]}
    calls = []

    def encode(words):
        calls.append(len(words))
        return [told[w] for w in words]

    cache = ta.WordCache(ta.Encoder(encode, ta._vocabulary(entries), True), "")
    cache.learn(set(told))
    known = {w: None if ids is None else np.frombuffer(ids, np.int32).tolist() for w, ids in cache.known.items()}
    assert known == {w: ids if b"".join(entries[i] for i in ids) == b" " + w.encode() else None for w, ids in told.items()}
    cache.learn(set(told))
    assert calls == [len(told)]  # nothing is encoded when all words are known
