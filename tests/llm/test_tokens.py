import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm import charsmap, encoders, piece_codec, runs, token_counts, token_files
from cadenza.llm.charsmap import CharsMap, normalise, normalizer_spec, spans

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "b", "'s", "\n", "\t", "é", "<|endoftext|>", "▁", ".", ",", "1", "\xa0", "\x1c", "日", "\U0001f600", "<s>", "<0x41>", "\0", "\r", "word", "Word", "***"]


def texts(n=3000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(n)] + ["", " ", "  ", "\n", "x " * 20_000, "y" * 50_000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTES)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows(spark):
    found = [(i, t, "x") for i, t in enumerate(texts(400))] + [(1000, None, None), (7, "same again", "x"), (None, "no id", "x")]
    return spark.createDataFrame(found, "doc_id long, text string, start string")


@pytest.mark.parametrize("most,size", [(50, 2_000), (100_000, 4_000_000), (100_000, 1)])
def test_runs_give_the_librarys_ids(library, monkeypatch, most, size):
    monkeypatch.setattr(runs.slices, "__defaults__", (size,))
    e = encoders.load(BYTES)
    found = pa.array([*texts(), None])
    for _ in range(2):
        table = runs.RunTable(e.runs, e.each, np.dtype("<u4"), most=most)
        for text, ids in zip(found.to_pylist(), table.ids(found), strict=True):
            assert ids.tolist() == library(text or ""), text and text[:80]
        hot = {"a": 1, "word": 1}
        table = runs.RunTable(e.runs, e.each, hot=hot, most=most)
        assert table.counts(found).tolist() == [len(library(t or "")) for t in found.to_pylist()]
        found = found.slice(7)


def test_odd_runs_are_told_alike():
    found = [x for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]) for x in (c, f"a{c}", f"{c}a", f"a{c}a")] + ["", "a\n", "a\r\n"]
    assert runs.pc.match_substring_regex(pa.array(found), runs._ODD).to_pylist() == list(map(runs.odd, found))


def test_runs_of_documents_give_the_librarys_ids(spark, library):
    found = pa.array([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    e = encoders.load(BYTES)
    table = runs.RunTable(e.runs, e.each, np.dtype("<u2"))
    for text, ids in zip(found.to_pylist(), table.ids(found), strict=True):
        assert ids.tolist() == library(text or "")


def test_token_files(spark, rows, library, tmp_path):
    folder = f"file://{tmp_path}/t"
    written = token_files.write(rows, folder, BYTES, length=64, partitions=3)
    got = sorted(token_files.documents_of(spark, folder, written).collect(), key=lambda r: r.start)
    want = sorted(rows.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = np.array([*library(w.text or ""), 0], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    file = token_files.TokenFile(folder, written[0].path, written[0].docs_path)
    ids, mask = file.batch(0)
    assert not ids.flags.owndata and ids.shape[1] == 64 and mask.shape[1] == 8
    n = written[0].n_ids
    last, real = file.row((n - 1) // 64)
    assert real.sum() == (n - 1) % 64 + 1 and not last[~real].any()


def test_token_files_of_one_id_lie_in_many_files(spark, tmp_path):
    rows = spark.createDataFrame([(5, f"{k % 40} text {k}") for k in range(400)] + [(1, None), (None, "x")], "doc_id long, text string")
    written = token_files.write(rows, f"file://{tmp_path}/t", BYTES, length=64, partitions=4)
    assert len(written) == 4 and max(r.n_docs for r in written) < 250
    got = sorted(token_files.documents_of(spark, f"file://{tmp_path}/t", written).collect(), key=lambda r: r.start)
    e = encoders.load(BYTES)
    texts = ["x", "", *sorted(f"{k % 40} text {k}" for k in range(400))]
    assert [g.ids_crc32 for g in got] == [zlib.crc32(np.append(e.whole([t])[0], 0).astype("<u4").tobytes()) for t in texts]


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    written = token_files.write(empty, f"file://{tmp_path}/t", BYTES)
    assert token_files.documents_of(spark, f"file://{tmp_path}/t", written).count() == 0


def test_piece_codec(spark, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {(r.doc_id, r.decoded): r for r in piece_codec.encode(rows, PIECES, ["ids", "begins", "ends", "decoded", "n_tokens", "span_bytes"]).collect()}
    for w in rows.collect():
        text = w.text or ""
        ids = sp.encode(text)
        g = got[w.doc_id, sp.decode(ids)]
        assert g.ids == ids and g.n_tokens == len(ids) and g.span_bytes == len(text.encode())
        assert g.begins[1:] == g.ends[:-1]
        assert all(sp.id_to_piece(i).replace("▁", " ").strip() == text.encode()[a:b].decode().replace("▁", " ").strip() for i, a, b in zip(ids, g.begins, g.ends) if not sp.is_byte(i))
    back = piece_codec.decode(piece_codec.encode(rows, PIECES, ["ids"]), PIECES)
    assert back.where("doc_id = 7 and decoded = 'same again'").count() == 1


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_meets_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = normalizer_spec(library.serialized_model_proto())
    r = random.Random(3)
    parts = [*PARTS, "Ａ", "ﬁ", "①", "ｱ", "ﾞ", "İ", "ß", "Ⅷ", "é", "　"]
    for _ in range(1500):
        text = "".join(r.choices(parts, k=r.randint(0, 12)))
        out, aligned = normalise(text, spec)
        assert out.decode() == library.normalize(text)
        assert len(aligned) == len(out) + 1 and (np.diff(aligned) >= 0).all()


def brute_spans(ids, sp, text):
    """Source spans of pieces for an empty map: every byte is itself, but spaces, which are three bytes, and the prefix."""
    places = [0, 0, 0]
    for k, b in enumerate(text.encode()):
        places += [k] * (3 if b == 32 else 1)
    places.append(len(text.encode()))
    at, out = 0, []
    for i in ids:
        n = 1 if sp.is_byte(i) else len(sp.id_to_piece(i).encode())
        out.append((places[at], places[at + n]))
        at += n
    assert at == len(places) - 1
    return out


def test_codec_meets_brute_force(spark, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in rows.collect():
        ids = sp.encode(r.text or "")
        found = np.array(brute_spans(ids, sp, r.text) if ids else [], "<i8").reshape(-1, 2)
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(sp.decode(ids).encode()), sha(found.T.tobytes()))] += 1
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    assert Counter(map(tuple, piece_codec.encode(rows, PIECES, columns).collect())) == want
    assert piece_codec.encode(rows.limit(0), PIECES, columns).count() == 0


def with_map(path):
    """PIECES with the character map and the space rules of nmt_nfkc in its place, as a model file."""
    field = lambda n, data: bytes([n << 3 | 2]) + varint(len(data)) + data

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    with open(PIECES, "rb") as f:
        model = f.read()
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    new = field(3, next(v for n, v in charsmap._fields(rule) if n == 3))
    path.write_bytes(model + new)  # a later message is merged over the earlier one
    return str(path)


def test_codec_of_a_model_with_a_map(spark, tmp_path):
    path = with_map(tmp_path / "mapped.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.Codec(path)
    assert codec.table.units
    found = ["ﬁne  Ⅷ ＡＢ x", " a  b ", "ｱﾞ①", "plain words", "日本 é", ""]
    for text, (ids, begins, ends, decoded) in zip(found, codec.rows(found)):
        assert ids == sp.encode(text) and decoded == sp.decode(ids)
        out, aligned = normalise(text, codec.encoder.spec)
        assert len(begins) == len(ids) and (begins <= ends).all() and (begins[1:] >= begins[:-1]).all()
        if ids:
            surfaces = piece_codec._surfaces(sp.encode(text, return_type="proto").pieces)
            assert b"".join(s if s != b"\0" else out[k : k + 1] for s, k in zip(surfaces, np.cumsum([0, *map(len, surfaces)]))) == out
            assert list(zip(begins.tolist(), ends.tolist())) == spans(surfaces, aligned)
    first = dict(zip(codec.encoder.model.encode("ﬁne", out_type=str), zip(*(x.tolist() for x in codec.spans("ﬁne", sp.encode("ﬁne"))))))
    assert max(b for _, b in first.values()) == len("ﬁne".encode())


def test_spans_through_a_character_map():
    spec = normalizer_spec(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    out, aligned = normalise("ﬁ Ⅷ", spec)
    assert CharsMap(spec.charsmap).longest("ﬁ".encode(), 0) == (3, b"fi")
    assert spans(["▁fi".encode(), "▁VIII".encode()], aligned)[0] == (0, 3)


@pytest.mark.parametrize("frequent", [0, 3, 50])
def test_counts(spark, rows, library, frequent):
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library(r.text or "")), n > 512) for r in rows.collect())
    assert Counter(map(tuple, token_counts.count_tokens(rows, BYTES, 512, frequent).collect())) == want
    assert token_counts.count_tokens(rows.limit(0), BYTES, 512, frequent).count() == 0


def test_frequent_runs_are_bounded(spark):
    rows = spark.createDataFrame([(" ".join(f"x w{k} w{k}" for k in range(j, 300)),) for j in range(8)], "text string").repartition(4)
    found = token_counts.frequent_runs(rows, 40)
    assert 0 < found.count() <= 40 and found.where("run = 'x' and n >= 2000").count() == 1


def test_counts_of_pieces(spark, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_counts.count_tokens(rows, PIECES, 512).join(rows.where("doc_id != 7").select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(sp.encode(r.text or ""))


def test_reader_of_a_far_store_reads_each_batch_once(spark, tmp_path, monkeypatch):
    """Documents one after another take at most one read of each batch where files can't be mapped."""
    import pyarrow.fs as pafs

    from cadenza.llm import common

    docs = spark.createDataFrame([(k, f"text {k} of many words") for k in range(400)], "doc_id long, text string")
    rows = token_files.write(docs.coalesce(1), f"file://{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"), length=8, partitions=1)
    plain = common.filesystem
    monkeypatch.setattr(common, "filesystem", lambda uri: (pafs.SubTreeFileSystem("/", plain(uri)[0]), plain(uri)[1]))
    file = token_files.TokenFile(f"file://{tmp_path}/t", rows[0].path, rows[0].docs_path)

    class Counted:
        def __init__(self, reader):
            self.reader, self.reads, self.schema = reader, [], reader.schema

        def get_batch(self, k):
            self.reads.append(k)
            return self.reader.get_batch(k)

    file.reader = Counted(file.reader)
    first, count = file.docs["first"].to_pylist(), file.docs["n_tokens"].to_pylist()
    assert sum(len(file.ids(a, n)) for a, n in zip(first, count)) == rows[0].n_ids
    assert len(file.reader.reads) == len(set(file.reader.reads))


def test_unknown_stores_fail_at_the_start(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="nowhere"):
        token_files.write(docs, "nowhere://x/y", public_tokenizers.path("byte_bpe_50k.json"))
