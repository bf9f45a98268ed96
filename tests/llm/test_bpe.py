import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from odd_tables import no_docs, odd_docs  # noqa: F401
from authorloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(text):
    raw = bpe.codec(PATH, PATTERN).encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdest 'll\n\t09é漢🎉-=\x1c\x85"), max_size=200) | st.text(max_size=60))
def test_same_ids_as_the_library(known, text):
    assert ids(text) == known.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 6000, "\n" * 5000, "漢" * 3000, " " * 20_000, "-=" * 9000])
def test_long_pieces(known, text):
    assert ids(text) == known.encode_ordinary(text)


def test_tables_that_fill_up_do_not_matter(known, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 20)
    monkeypatch.setattr(bpe, "PIECES", 3)
    text = "several unlikely wordsesque thingamabobs, againish and againish"
    coder = bpe.Codec(PATH, PATTERN)
    for _ in range(3):
        raw = coder.encode(text)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == known.encode_ordinary(text)


@given(st.text(max_size=50), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_streamed_bytes_give_the_text(text, n):
    data, stream = text.encode(), bpe.Utf8Stream()
    parts = [stream.feed(data[i : i + n]) for i in range(0, len(data), n)]
    assert "".join(parts) + stream.close() == text


def test_broken_bytes_end():
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xe6\xbc") == "a" and stream.close() == "�"


def test_frames(odd_docs, no_docs, known):
    rows = {r.doc_id: r for r in bpe.round_trip(odd_docs, PATH, PATTERN).collect()}
    for r in odd_docs.collect():
        expected = known.encode_ordinary(r.text or "")
        assert rows[r.doc_id].n_tokens == len(expected)
        digest = hashlib.sha256(struct.pack(f"<{len(expected)}I", *expected)).hexdigest()
        assert rows[r.doc_id].ids_sha256 == digest
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    coded = bpe.encode(odd_docs, PATH, PATTERN)
    assert coded.columns == [*odd_docs.columns, "ids"]
    back = {r.doc_id: r.decoded for r in bpe.decode(coded, PATH, PATTERN, chunk=3).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert bpe.round_trip(no_docs, PATH, PATTERN).count() == 0


def test_round_trip_decodes_as_a_stream(monkeypatch, spark):
    """Code points cut by chunks of one token are whole again in the digest; broken bytes would show."""
    text = "漢字 🎉 é" * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = bpe.round_trip(docs, PATH, PATTERN, chunk=1).first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    used = []
    coder = bpe.Codec(PATH, PATTERN)
    stream = coder.decode_stream
    monkeypatch.setattr(coder, "decode_stream", lambda parts: used.append(1) or stream(parts))
    monkeypatch.setattr(bpe, "codec", lambda path, pattern: coder)

    class Docs:
        """Runs the function that Spark would, here."""

        sparkSession, schema = docs.sparkSession, docs.schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter(docs.toArrow().to_batches())))

    got = bpe.round_trip(Docs(), PATH, PATTERN, chunk=1)
    assert used and got[0].column("decoded_sha256")[0].as_py() == row.decoded_sha256
