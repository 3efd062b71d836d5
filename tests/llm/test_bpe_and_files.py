"""Byte-level BPE and token files against the libraries' own answers on whole texts."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tallywork.llm import byte_bpe, token_files
from samples import edge_pages, no_pages  # noqa: F401

RULES = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def texts_of(pages):
    return [(r["page_id"], r["html"]) for r in pages.select("page_id", "html").collect()]


def test_ids_and_bytes_are_those_of_the_library(edge_pages):
    encoding = byte_bpe.load_encoding(*RULES)
    got = byte_bpe.decode_pages(byte_bpe.encode_pages(edge_pages, *RULES, "html"), *RULES).collect()
    once = byte_bpe.round_trip_pages(edge_pages, *RULES, "html").select(*byte_bpe.decode_pages(
        byte_bpe.encode_pages(edge_pages, *RULES, "html"), *RULES).columns).collect()
    assert sorted(map(str, once)) == sorted(map(str, got))
    assert len(got) == edge_pages.count()
    for row in got:
        want = encoding.encode_ordinary(row["html"] or "")
        assert np.frombuffer(row["ids"], "<u4").tolist() == want and row["n_tokens"] == len(want)
        assert bytes(row["decoded"]) == (row["html"] or "").encode()


def test_empty_table_and_broken_bytes(spark, no_pages):
    assert byte_bpe.encode_pages(no_pages, *RULES).count() == 0
    ids = byte_bpe.load_encoding(*RULES).encode_ordinary("é")  # a part of a character decodes to its raw byte
    assert len(ids) == 1 or ids
    split = spark.createDataFrame([(1, bytearray(np.array([133], "<u4").tobytes())), (2, None)], "page_id long, ids binary")
    assert len(byte_bpe.decode_pages(split, *RULES).orderBy("page_id").collect()[0]["decoded"]) == 1


@pytest.mark.parametrize("text", [
    "a1!b'2's 'tis don't " * 9, "x" * 300, "  \n\n\t  a " * 40, "12ab!?'s'" * 50, "é1é!é 's" * 40, "　 \x1c\x1d a" * 30, "''''s" * 40])
def test_cuts_never_change_ids(text):
    encoding = byte_bpe.load_encoding(*RULES)
    pieces = list(byte_bpe.safe_pieces(text, 7))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_token_files_hold_every_id_in_order(spark, edge_pages, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    files = token_files.write_token_files(edge_pages, str(tmp_path / "f"), P.path("word_bpe_49k.json"), tokens_a_file=30)
    listed = files.orderBy("first_token").collect()
    assert len(listed) > 3
    got = token_files.read_token_files(files).orderBy("start").collect()
    rows = texts_of(edge_pages)
    assert [r["page_id"] for r in got] == sorted((p for p, _ in rows), key=lambda p: (p is not None, p or 0))
    at, everything = 0, []
    for row in got:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert row["start"] == at and row["n_tokens"] == len(ids) and ids[-1] == 1
        at += len(ids)
        everything += ids
    want = {}
    for page_id, text in rows:
        want.setdefault(page_id, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    have = {}
    for row in got:
        have.setdefault(row["page_id"], []).append(np.frombuffer(row["ids"], "<u4").tolist())
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    places = [0, 1, at - 1, at // 2, at // 3, 17, at + 5, -3]
    found = token_files.read_tokens(files, spark.createDataFrame([(p,) for p in places] + [(None,)], "place long")).collect()
    assert sorted((r["place"], r["id"]) for r in found) == sorted((p, everything[p]) for p in places if 0 <= p < at)


def test_query_gives_the_library_s_ids_of_markers(spark, edge_pages, tmp_path):
    from tokenizers import Tokenizer

    from tallywork.llm.queries import op1_token_files

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))  # as it is
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [
        f"page end {end} next", end, f"{start}{end}{end}", f"Don't{start}'s x.{end}", f"A.{end} b. <|EndOfText|> C", f"e{end}\u0301 é{end}É",
        f"x<{end}>{end[:-1]} {end[:5]} {end[5:]}", f" \n{end}\t{start} \n", f"{'Many words, ' * 9000}{end}{'and more. ' * 9000}", "<|ENDOFTEXT|>", "no marker."]
    texts += [text for _, text in texts_of(edge_pages)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    at, want = 0, []
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op1_token_files(spark, str(tmp_path)).collect())) == want
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [2504, 806, 49407, 1131]


def test_no_file_for_no_page(no_pages, tmp_path):
    files = token_files.write_token_files(no_pages, str(tmp_path / "f"), P.path("word_bpe_49k.json"))
    assert files.count() == 0 and token_files.read_token_files(files).count() == 0


def test_random_access_equals_the_array():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 1 << 32, 3000, "uint64").astype("u4"), np.arange(2000, dtype="u4") % 300, np.zeros(513, "u4"), np.zeros(0, "u4")):
        file = token_files.TokenFile(token_files.token_file_bytes(ids, [1], [len(ids)]))
        assert (file.all_ids() == ids).all()
        places = rng.integers(0, max(1, len(ids)), 500) if len(ids) else np.zeros(0, "int64")
        assert (file[places] == ids[places]).all()
    with pytest.raises(IndexError):
        file[[0]]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else")


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u3000", " \n"])
@pytest.mark.parametrize("around", ["{}", "x{}", "{}y", "x{}y z{}'s", "{}\x1c{}"])
def test_long_white_space_as_the_library_has_it(space, around):
    encoding = byte_bpe.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = around.replace("{}", space * (byte_bpe.LONG_TEXT + 1001))
    assert byte_bpe.encode_text(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\t", "\n"])
def test_white_space_beyond_what_the_pattern_bears(space):
    encoding = byte_bpe.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in (space * 5_000_000, "x" + space * 5_000_000, space * 5_000_000 + "y"):
        ids = byte_bpe.encode_text(encoding, text)
        assert encoding.decode(ids) == text
