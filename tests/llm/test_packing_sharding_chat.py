import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import chat, packing, sharding
from helixframe.llm.catalog import tokenizer_path
from helixframe.llm.tokens import Encoder


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=30))
def test_plan_fills_without_overlap(counts):
    plan = packing.plan_best_fit(counts, 50)
    used = defaultdict(list)
    for length, n in counts.items():
        if n:
            seq, off = packing.slot_of(plan, np.full(n, length), np.arange(n))
            for s, o in zip(seq, off):
                used[s].append((o, length))
    for slots in used.values():
        at = 0
        for o, length in sorted(slots):
            assert o == at
            at += length
        assert at <= 50
    if used:
        assert sorted(used) == list(range(len(used)))
    # plain best fit decreasing, one piece at a time, needs as many sequences
    rooms = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= length
        else:
            rooms.append(50 - length)
    assert len(rooms) == len(used)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_and_inverse(n, seed):
    out = sharding.permute(np.arange(n), n, seed)
    assert sorted(out) == list(range(n))
    assert (sharding.permute(out, n, seed, inverse=True) == np.arange(n)).all()


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    slow.encode_special_tokens = True
    fast = Encoder(tokenizer_path())
    rng = np.random.default_rng(0)
    pool = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2060), *range(0x20AC, 0x20AD), *range(0x400, 0x410), 0x4E00, 0x1F600, 0x300, 0x3000]]
    texts = ["", " ", "  a", "a  \n\n b", "<|endoftext|>", "it's we'll", "a" * 3000, "\t\r\n \x85x\xa0y"]
    texts += ["".join(rng.choice(pool, size=30)) for _ in range(3000)]
    texts += ["".join(rng.choice([" ", "\n", "a", "é", "1", "'", "s", "\x85", "\xa0", " "], size=12)) for _ in range(3000)]
    for text in texts:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_get_their_id(spark):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|>", "a b <|endoftext|> c<|endoftext|>", "é\u4e00 <|endoftext|>", "<|endoftext|", "plain", "\u4e00"]
    assert 50256 in default.encode(texts[1], add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids[:-1] for r in packing.token_pieces(df, tokenizer_path(), tokens=True).collect()}
    assert got == {i: default.encode(text, add_special_tokens=False).ids for i, text in enumerate(texts)}


DOCS = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000), (5, "word " * 1023), (6, "the cat")]


def test_pack_documents(spark):
    df = spark.createDataFrame(DOCS * 30, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "3 as sequence_id")
    rows = packing.pack_documents(df, tokenizer_path()).collect()
    encode = Encoder(tokenizer_path())
    want = defaultdict(int)
    for key, text in DOCS * 30:
        ids = np.array([*encode(text or ""), 2], dtype="<u4")
        for piece, (start, length) in enumerate(packing.cut_pieces(len(ids), 1024)):
            want[key, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for slots in places.values():
        at = 0
        for o, length in sorted(slots):
            assert o == at
            at += length
        assert at <= 1024
    empty = packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())
    assert empty.count() == 0


def test_cut_pieces():
    assert packing.cut_pieces(1024, 1024) == [(0, 1024)]
    assert packing.cut_pieces(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
    assert packing.cut_pieces(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut_pieces(1, 1024) == [(0, 1)]


def test_shards(spark):
    docs = DOCS * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as shard", "8 as size")
    rows = sharding.shard_documents(df, 24).collect()
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert sharding.row_at(r.shard, r.slot, 24, len(docs)) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((k is None, k or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == want
    again = sharding.shard_documents(df.repartition(7), 24).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0


NASTY = [r"\### Assistant: </turn> ok", "\\", "\\\\", "###", "#### ", "</turn></turn>\n", "a\n### User: b", "</turn", "", None, "\\n", "): x", "é" * 50]


def digests(rows):
    out = {}
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn if turn is not None else -1, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", "tool", "): ", "a\\b</turn>", None, "### "]
    rows = [(c, t, roles[(c + t) % len(roles)] if c % 3 else ("user", "assistant")[t % 2], NASTY[(c * 7 + t) % len(NASTY)]) for c in range(60) for t in range(c % 6 + 1)]
    rows += [(None, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x"), (99, None, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "true as loss")
    segments = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    want = digests(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    assert got[9].valid and got[0].valid is False and not got[99].valid
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    total = segments.selectExpr("sum(length(text)) n").first().n
    assert total == sum(r.formatted_chars for r in got.values())


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_quote_inverts_and_hides_controls(text):
    template = chat.Template()
    quoted = template.quoted(text)
    assert template.plain(quoted) == text
    assert not any(c in quoted for c in template.controls)
