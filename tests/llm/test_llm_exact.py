"""Exact copies, token files, packing and the piece codec against plain restatements."""

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsgauge.llm.common import shared_folder
from newsgauge.llm.exact_dedup import exact_dedup
from newsgauge.llm.packing import Packer, Steps, pack_documents
from newsgauge.llm.piece_codec import PIECES, PieceCodec, decode_pieces, encode_pieces
from newsgauge.llm.token_files import pack_ranks, read_token_files, unpack_ranks, write_token_files
from newsgauge.llm.tokens import BYTE_BPE, WORD_BPE, TextEncoder, text_encoder, tokenizer_file


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


def expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((doc_id, keep, len(groups[norm]), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    """With a hash that collides for almost all texts the result is the same."""
    hashed = {"content_hash": lambda t: F.md5(F.substring(t, 1, 1))} if weak else {}
    got = exact_dedup(docs, **hashed)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, got.collect())) == expected_copies(rows)


def test_exact_dedup_carries_columns(docs, no_docs):
    out = exact_dedup(docs, keep=["text", "_hash", "_norm", "_keep0"])
    assert out.count() == docs.count() and out.where("_norm <> 'clash' or _hash <> 'clash' or _keep0 <> 'clash'").count() == 0
    assert exact_dedup(no_docs).count() == 0


def test_exact_dedup_stays_in_the_jvm(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 300)))
def test_rank_bytes_round_trip(ranks):
    control, data = pack_ranks(np.array(ranks, np.uint32))
    assert unpack_ranks(control, data, len(ranks)).tolist() == ranks
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_word_memory_gives_the_librarys_ids(name, texts):
    own, other = TextEncoder(name, entries=5), library(name)
    for text in [t or "" for t in texts]:
        assert np.frombuffer(own(text), own.dtype).tolist() == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abTSs'éßİΣ½日 \n\t\x1c\x85\xa0.,-0<|>") + ["'ll", "ing", "the"]), max_size=30).map("".join))
def test_word_memory_on_odd_texts(text):
    for name in (BYTE_BPE, WORD_BPE):
        own = text_encoder(name)
        assert np.frombuffer(own(text), own.dtype).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abTS'éßΣ日 \n\t\x85\xa0.,0  ") + ["ing", " the", "<|endoftext|>", "<|"]), max_size=20).map("".join), max_size=6))
def test_many_texts_at_once(texts):
    own, other = text_encoder(BYTE_BPE), library(BYTE_BPE)
    bounds, ids = own.many(texts, 0)
    got = [np.frombuffer(ids, own.dtype, (b - a) // own.width, a).tolist() for a, b in zip(bounds, bounds[1:])] if texts else []
    assert got == [other.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_special_strings_get_the_librarys_ids():
    for name, special in ((BYTE_BPE, ["<|endoftext|>"]), (WORD_BPE, ["<|endoftext|>", "<|startoftext|>"])):
        own, other = text_encoder(name), library(name)
        for s in special:
            ids = other.encode(s, add_special_tokens=False).ids
            assert len(ids) == 1
            for text in (s, f"hello {s} world", f"a{s}b  {s}\n"):
                got = np.frombuffer(own(text), own.dtype).tolist()
                assert got == other.encode(text, add_special_tokens=False).ids and ids[0] in got


def test_token_files(spark, docs):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    got = sorted(read_token_files(spark, write_token_files(docs, path, block_ids=64)).collect(), key=lambda r: r["start"])
    tokenizer = library(BYTE_BPE)
    want = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == Counter((d, len(i), crc(i)) for d, i in want)
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    ranks = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    counts = Counter(i for _, ids in want for i in ids)
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))


def test_token_files_of_an_empty_table(spark, no_docs):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    assert read_token_files(spark, write_token_files(no_docs, path)).count() == 0


def test_packing(docs, no_docs):
    rows = pack_documents(docs).collect()
    tokenizer = library(WORD_BPE)
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])] += 1
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"])
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert total <= 2048 and total & (total - 1) == 0 and {r["tier"] for r in pieces} == {total}
        assert len({r["step_group"] for r in pieces}) == 1
    ids = defaultdict(list)
    for r in rows:
        ids[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for (doc_id, tokens), times in want.items():
        mine = [(s, i) for s, i, n in ids[doc_id] if n == len(tokens)]
        whole = Counter(at for s, i in mine for at in range(s, s + len(i)))
        assert set(whole.values()) == {times} and len(whole) == len(tokens)
        assert all(list(tokens[s:s + len(i)]) == i for s, i in mine)
    assert pack_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.integers(1, 20))
def test_packer_fills_every_window(lengths, every):
    packer, windows = Packer(), []
    for doc, n in enumerate(lengths):
        windows += packer.add(doc, n)
        if doc % every == 0:
            windows += packer.flush()
    windows += packer.finish()
    assert all(sum(p[2] for p in pieces) == size and size & (size - 1) == 0 for size, pieces in windows)
    assert sum(size for size, _ in windows if size < 256) < 256
    places = sorted((doc, start, n) for _, pieces in windows for doc, start, n in pieces)
    want = [(doc, at) for doc, n in enumerate(lengths) for at in range(n)]
    assert [(doc, start + k) for doc, start, n in places for k in range(n)] == want


def test_step_groups_are_balanced():
    steps, total = Steps(0, 4096), Counter()
    for size in [2048, 512, 512, 2048, 2048, 512] * 40:
        total[steps.of(size), size] += size
    assert len({g for g, _ in total}) == len(total)
    assert sorted(total.values())[2:] == [4096] * (len(total) - 2)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return PieceCodec(), sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abcderstino ,.-é日\n\t0") + ["  ", "the", " the", "tion", "    "]), max_size=80).map("".join))
def test_streamed_pieces_are_the_librarys(pieces, text):
    own, other = pieces
    assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode(text)
    marked = (" " + text).replace(" ", "▁")
    streamed = [i for p in own._streamed(marked) for i in own.model.ids_of(p)]
    assert not text or streamed == other.encode(text)
    assert own.model.path(marked) == list(own._streamed(marked))
    assert own.model.merged(marked) == list(own._streamed(marked))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_comes_back(pieces, text):
    assert pieces[0].decode(pieces[0].encode(text)) == text


def test_stream_holds_a_bounded_window(pieces):
    from newsgauge.llm.piece_codec import StreamEncoder

    stream, most, out = StreamEncoder(pieces[0].model), 0, []
    text = "".join("abcdefghij klmn"[i * i % 15] for i in range(3000)).replace(" ", "▁")
    for c in text:
        out += stream.feed(c)
        most = max(most, len(stream.text))
    assert "".join(out + stream.finish()) == text and most <= 4 * stream.model.longest


def test_piece_queries(docs, no_docs):
    got = decode_pieces(encode_pieces(docs))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert decode_pieces(encode_pieces(no_docs)).count() == 0


def test_parts_of_words_are_encoded_once(pieces):
    """No piece joins letters with punctuation, digits or another script, so a word is known behind any of them."""
    codec, library = PieceCodec(), pieces[1]
    text = "harbour, harbour; harbour... harbour2024 harbourгавань (harbour)  harbour \n\t harbour's 据数,一个 ‘harbour’   "
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text)
    assert codec.decode(codec.encode(text)) == text
    assert [part for part in codec.words if "harbour" in part] == [" harbour", "harbour", "  harbour"]
    assert "".join(codec.model.parts(" " + text)) == " " + text
