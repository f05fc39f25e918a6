"""Token files and SentencePiece against the libraries; WARC packages by round trip."""

import gzip
import hashlib
import io
import json
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfgraph.llm import sentence_pieces, token_files, warc_zip
from shelfgraph.llm.text import chunks
from tests.llm.common import LONG, PROSE, nothing, odd, odd_rows, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "Hello  world\n\tfoo  ", "é ﬁ é 　 x 😀", "a<s>b </s> <0x41>", "x" * 40, " " * 46 + "ab", "a▁b ▁ c▁", "▁ a", "\n a\n\n b ",
       "日本語のテキスト処理", "don't I'm 12.5 a.b,c!!", "ΣΑΣ Σ. É.é,É 한국어", "a<|endoftext|> x<|startoftext|>y", "www.example.com/p?x=1&y=2", "a\x1cb\u0085c", PROSE, " " * 100 + "the"]


def texts(sf="0.001"):
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '/root/testdata/sf{sf}/documents.parquet' ORDER BY doc_id").fetchall()]


def sequences(encoder, rows):
    got = [encoder.encode(c) for c in chunks(pa.array(rows, pa.string()))]
    ids, sizes = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    return [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, int(rng.integers(1, 10 ** int(rng.integers(1, 10)))), int(rng.integers(1, 3000))))
    coded = token_files.EliasFano.read(io.BytesIO(token_files.EliasFano.encode(values).to_bytes()))
    assert (coded.values() == values).all() and (coded.select(np.arange(len(values))) == values).all()
    assert len(coded.low) + len(coded.high) <= len(values) * (2 + max(0, np.log2(max(1, values[-1]) / len(values)))) / 8 + 2 * token_files.BLOCK


def test_elias_fano_of_nothing():
    coded = token_files.EliasFano.read(io.BytesIO(token_files.EliasFano.encode(np.zeros(0, np.int64)).to_bytes()))
    assert len(coded.values()) == 0


@pytest.mark.parametrize("path", [VOCABULARY, public_tokenizers.path("byte_bpe_50k.json")])
def test_word_encoder_equals_the_library(path):
    rows = texts() + ODD
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    assert sequences(token_files.WordEncoder(path), rows) == want


def test_token_files(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    manifest = token_files.write_token_files(odd(spark).repartition(5), VOCABULARY, file_ids=1000)
    got = token_files.read_token_files(manifest).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    library = Tokenizer.from_file(VOCABULARY)
    start, want = 0, []
    for i in order:
        ids = [*library.encode(rows[i][1] or "", add_special_tokens=False).ids, 1]
        want.append((rows[i][0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want and manifest.count() > 1
    one = {(r.id, tuple(r.ids)) for r in token_files.document_ids(spark, manifest).filter("id = 9").collect()}
    assert one == {(9, (*library.encode(PROSE * 5, add_special_tokens=False).ids, 1))}
    assert token_files.read_token_files(token_files.write_token_files(nothing(spark), VOCABULARY)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load(MODEL)


def test_bpe_segmentation_equals_the_library(pieces):
    rng = np.random.default_rng(1)
    letters = list("abcdetheinr  .,\n▁é😀ñ")
    rows = texts() + ODD + ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(500)] + [LONG[:50_000]] + [" " * n + "the" + " " * n for n in range(40)]
    assert sequences(sentence_pieces.PieceEncoder(pieces), rows) == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(rows)


def unigram_pieces():
    """A small unigram model: pieces with scores, no byte pieces."""
    model = sentence_pieces.Model.__new__(sentence_pieces.Model)
    model.pieces = ["<unk>", "<s>", "▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "ca", "▁ab", "bcab"]
    rng = np.random.default_rng(2)
    model.scores = [0.0, 0.0, *(-rng.uniform(0.5, 6, len(model.pieces) - 2).astype(np.float32)).tolist()]
    model.kinds = [sentence_pieces.UNKNOWN, sentence_pieces.CONTROL, *[sentence_pieces.NORMAL] * (len(model.pieces) - 2)]
    model.algorithm, model.dummy_prefix = sentence_pieces.UNIGRAM, True
    return model


def test_unigram_segmentation_has_the_best_score():
    model = unigram_pieces()
    found = sentence_pieces.Pieces(model)
    score = dict(zip(model.pieces, model.scores, strict=True))
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list("abc "), int(rng.integers(1, 14)))) for _ in range(200)]
    for text, ids in zip(rows, sequences(sentence_pieces.PieceEncoder(found), rows), strict=True):
        whole = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e9] * len(whole)
        for end in range(1, len(whole) + 1):
            best[end] = max(best[end - n] + score[whole[end - n:end]] for n in range(1, 5) if n <= end and whole[end - n:end] in score)
        assert "".join(model.pieces[i] for i in ids) == whole
        assert sum(model.scores[i] for i in ids) == pytest.approx(best[-1], abs=1e-4)
    assert sequences(sentence_pieces.PieceEncoder(found), ["axxa"]) == [[6, 0, 3]]


def test_encode_decode_round_trip(spark, pieces):
    back = sentence_pieces.decode(sentence_pieces.encode(odd(spark), pieces), pieces)
    want = [(r[0], (r[1] or "").replace("▁", " ")) for r in odd_rows()]
    assert sorted(((r.id, r.text) for r in back.collect()), key=repr) == sorted(want, key=repr)
    trip = sentence_pieces.round_trip(odd(spark), pieces, with_ids=True)
    assert trip.count() == len(want) and trip.filter("not restored").count() == 0
    assert sentence_pieces.round_trip(nothing(spark), pieces).count() == 0 and sentence_pieces.encode(nothing(spark), pieces).count() == 0


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("limit", [None, 10])
@pytest.mark.parametrize("note", [b"", b"PK\x05\x06 in a comment"])
def test_zip_directories(monkeypatch, limit, note):
    if limit:  # everything above ten bytes or entries takes the ZIP64 forms
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    file = Bytes()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as out:
        out.comment = note
        for i in range(5):
            with out.open(f"d/m{i}é", "w", force_zip64=bool(limit)) as member:
                member.write(bytes([65 + i]) * (100 + i))
        out.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
    reader = warc_zip.ZipReader(file)
    assert list(reader.members) == [*(f"d/m{i}é" for i in range(5)), "packed"]
    assert reader.read("d/m3é") == b"D" * 103 and reader.read("d/m4é", 100, 50) == b"EEEE"
    assert list(reader.pieces("d/m1é", [(0, 3), (3, 0), (50, 2), (99, 2)], most=4)) == [b"BBB", b"", b"BB", b"BB"]
    with pytest.raises(ValueError, match="compressed"):
        reader.read("packed")


def test_no_zip():
    with pytest.raises(ValueError, match="end of central"):
        warc_zip.ZipReader(Bytes(b"nothing here"))


def test_packages(spark):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big + " "), (8, "u", big),
            (8, "u", big), (None, "u", "null id " * 20), (9, "u", "null id " * 20), (10, "u", LONG), (11, "u", LONG), (12, "u", "one of the rest " * 9)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(4)
    manifest = warc_zip.write_packages(pages, package_bytes=300)
    got = warc_zip.read_records(manifest).collect()

    def first(text):
        same = [r[0] for r in rows if r[2] == text]
        return None if None in same else min(same)

    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and page != first(html)
        want.append((page, None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), None if revisit else html or "", len(raw),
                     hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first(html) if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert manifest.count() > 1 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    uri = manifest.first().uri.removeprefix("file://")
    with zipfile.ZipFile(uri) as package:  # other readers can open it
        index = [json.loads(x) for x in package.read(warc_zip.INDEX).decode().split("\n")]
        archive = package.read(warc_zip.ARCHIVE)
        assert all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())
        assert all(gzip.decompress(archive[x["offset"]:x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n") for x in index)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read_records(warc_zip.write_packages(empty)).count() == 0


def test_long_unbroken_words_are_cut_where_no_piece_reaches():
    """Han characters without pieces, Japanese, accents and emoji, in words of thousands of characters: the library's ids, and no step for each character."""
    import random
    import time

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    from shelfgraph.llm import sentence_pieces
    from shelfgraph.llm.text import chunks
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    pools = [[chr(c) for c in range(0x4E00, 0x9FFF)], list("進撃の巨人ワンピース鋼のーａ々"), list("abcéñö😀日の"), list("the and ing"), ["▁", " ", "鋼", "a"]]
    texts = ["".join(rng.choice(pool) for _ in range(n)) for pool in pools for n in (1, 47, 48, 49, 50, 700)]
    encoder = sentence_pieces.PieceEncoder(sentence_pieces.load(path))
    for chunk in chunks(pa.array(texts)):
        ids, sizes = encoder.encode(chunk)
        cuts = np.cumsum([0, *sizes.tolist()])
        for k in range(chunk.n):
            assert ids[cuts[k]:cuts[k + 1]].tolist() == library.encode(texts[chunk.first + k]), texts[chunk.first + k][:60]
    long = "".join(rng.choice(pools[0]) for _ in range(32_000))
    began = time.process_time()
    [chunk] = chunks(pa.array([long]))
    ids, _ = encoder.encode(chunk)
    assert time.process_time() - began < 5 and ids.tolist() == library.encode(long)
