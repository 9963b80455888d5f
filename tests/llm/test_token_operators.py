"""Byte-level BPE and token alignment against the tokenizer libraries, word by word and text by text."""

import hashlib
import pickle
from collections import Counter

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from flowward.llm import bpe  # noqa: E402
from flowward.llm.alignment import align_tokens, alignment_digests, pair_counts  # noqa: E402
from flowward.llm.bpe import decode_ids, encode_documents, encoded_digests, piece_bytes  # noqa: E402
from llm.helpers import documents  # noqa: E402

ODD = [
    "", None, " ", "   ", "\n", "  lead", "trail  \n\n ", "a <|endoftext|>  b  \t\tc 　 d", "<|endoftext|>",
    "a<|endoftext|> <|endoftext|>", "it's  we'll\n\n\tgo 12 34", "é\u0085   e   x", "\U0001f600 \U0001f600\x00 \x1f a",
    "a▁b c", "<s> <0x41> <unk>", "x" * 40_000, "a b " * 20_000, "a b " * 20_000, "same text again", "same text again",
]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("hot_words", [1000, 3, 0])
def test_ids_and_texts_are_the_tokenizers(spark, byte_bpe, hot_words):
    rows = encode_documents(documents(spark, ODD, extra=True), hot_words=hot_words).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(ODD)))
    for r in rows:
        ids = byte_bpe.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == byte_bpe.decode(ids, skip_special_tokens=False)


def test_encoding_keeps_rows_without_ids_and_repeated_ones(spark):
    found = encoded_digests(documents(spark, [(None, "a b"), (None, None), (4, "a b"), (4, "a b"), (4, "c")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in found) == [(-1, 0), (-1, 2), (4, 1), (4, 2), (4, 2)]
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["ids_sha256"], r["decoded_sha256"]) for r in found if not r["n_tokens"]] == [(empty, empty)]
    assert encoded_digests(documents(spark, ["a"]).where("doc_id < 0")).count() == 0


def test_repeated_rows_of_words_that_tasks_do_not_hold(spark, byte_bpe):
    given = [(None, "q rr q"), (None, "q rr q"), (0, "q rr q"), (None, "sss"), *[(4, "rr  t")] * 300, (4, "t q")]
    found = encode_documents(documents(spark, given).repartition(5), hot_words=0).collect()
    wanted = Counter((k, *byte_bpe.encode(t, add_special_tokens=False).ids) for k, t in given)
    assert Counter((r["doc_id"], *r["ids"]) for r in found) == wanted
    assert sum(r["decoded"] == "rr  t" for r in found) == 300


def test_encoding_writes_no_table_of_the_texts(spark, monkeypatch):
    written, cut = [], bpe.Scratch.cut
    monkeypatch.setattr(bpe.Scratch, "cut", lambda self, df, **options: written.append(df.columns) or cut(self, df, **options))
    assert encode_documents(documents(spark, ODD), hot_words=3).count() == len(ODD)
    assert written and not any({"codes", "text", "decoded"} & set(columns) for columns in written)


def test_encoding_refuses_texts_that_change_between_readings():
    hot = bpe.HotWords(pa.table({"word": ["a"], "n": [1], "ids": [[64]], "other": pa.array([None], pa.string())}))
    kind = pa.list_(pa.struct({"k": pa.int32(), "ids": pa.list_(pa.int32()), "other": pa.string()}))
    rows = pa.record_batch({
        "doc_id": [1], "n_words": [2], "n_rare": [1], "n_bytes": [2],
        "codes": [bpe._packed(bpe.np.array([0, 1]), bpe.np.array([2]), bpe.np.frombuffer(b" b", "u1"))],
        "joined": pa.array([None], kind),
    })
    with pytest.raises(ValueError, match="not the same"):
        bpe._texts_of(hot, rows)


def test_words_that_tasks_hold_are_sent_without_what_follows_from_them():
    n = 50_000
    words, ids = [f" w{i:x}" for i in range(n)], [[i % 50_000, i % 97] for i in range(n)]
    other = [{5: "", 7: " longer \ufffd"}.get(i) for i in range(n)]
    rows = {"word": words, "n": range(n, 0, -1), "ids": pa.array(ids, pa.list_(pa.int32())), "other": pa.array(other, pa.string())}
    hot = bpe.HotWords(pa.table({k: pa.array(v) for k, v in rows.items()}))
    sent = pickle.dumps(hot)
    assert len(sent) < 10 * n  # hashes and numbers alone take 12 bytes a word
    got = pickle.loads(sent)
    hashes = bpe._row_hashes(*bpe._flat_bytes(pa.array([*words, "absent", ""])))
    assert got.find(hashes).tolist() == [*range(n), n, n] == hot.find(hashes).tolist()
    (id_bounds, text_bounds), text = got.bounds, got.text.tobytes()
    for i in (0, 4, 5, 6, 7, 8, n - 1):
        assert got.ids[id_bounds[i] : id_bounds[i + 1]].tolist() == ids[i]
        assert text[text_bounds[i] : text_bounds[i + 1]].decode() == (words[i] if other[i] is None else other[i])


def test_decoding_of_any_ids(spark, byte_bpe):
    lists = [[50256, 64], [], None, [163], [163, 64], [99_999, 64], [64] * 5000]
    table = spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>")
    for r in decode_ids(table).collect():
        known = [i for i in lists[r["k"]] or [] if i < 50257]
        assert r["decoded"] == byte_bpe.decode(known, skip_special_tokens=False)
    assert decode_ids(table.where("k < 0")).count() == 0


def aligned(texts):
    """What ``alignment_digests`` gives, by walking over the bytes of each text."""
    bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    of_a = piece_bytes(P.path("byte_bpe_50k.json"))

    def of_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    links, out, holds = [], [], Counter()
    for text in texts:
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        raw_a, raw_b = [of_a[i] for i in a], [of_b(i) for i in b]
        wanted = (" " + (text or "")).encode()
        if b"".join(raw_a) != wanted or b"".join(raw_b) != wanted:
            links.append(Counter())
            out.append((0, 0, 0, ""))
            continue
        owner_a = [k for k, x in enumerate(raw_a) for _ in x]
        owner_b = [k for k, x in enumerate(raw_b) for _ in x]
        links.append(Counter((a[i], b[j]) for i, j in set(zip(owner_a, owner_b, strict=True))))
        holds.update(set(links[-1]))
        groups, i, j = [], 0, 0
        for at in range(len(wanted)):
            if at + 1 == len(wanted) or (owner_a[at + 1] != owner_a[at] and owner_b[at + 1] != owner_b[at]):
                groups.append(",".join(map(str, a[i : owner_a[at] + 1])) + "|" + ",".join(map(str, b[j : owner_b[at] + 1])))
                i, j = owner_a[at] + 1, owner_b[at] + 1
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (a, _), n in holds.items():
        top[a] = max(top[a], n)
    return [
        (*o[:3], sum(x.values()), sum(n for p, n in x.items() if holds[p] == top[p[0]]), sum(n * holds[p] for p, n in x.items()), o[3])
        for o, x in zip(out, links, strict=True)
    ]


@pytest.mark.parametrize("hot_pairs", [100_000, 5, 0])
def test_alignment_follows_the_bytes(spark, hot_pairs):
    rows = alignment_digests(documents(spark, ODD, extra=True), hot_pairs=hot_pairs).collect()
    wanted = aligned(ODD)
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == dict(enumerate(wanted)) and len(rows) == len(ODD)


def test_no_expression_is_evaluated_on_each_group(spark, capsys):
    alignment_digests(documents(spark, ["hello world"])).explain(True)
    assert "lambda" not in capsys.readouterr().out


def test_alignment_gives_ids_groups_and_pairs(spark, byte_bpe):
    row = align_tokens(documents(spark, ["hello world hello"])).collect()[0]
    ids = byte_bpe.encode(" hello world hello", add_special_tokens=False).ids
    assert [i for g in row["groups"] for i in g["a"]] == ids and row["n_a"] == len(ids)
    assert sum(len(g["b"]) for g in row["groups"]) == row["n_b"]
    assert sum(p["n"] for p in row["pairs"]) == row["n_links"]
    assert align_tokens(documents(spark, ["a"]).where("doc_id < 0")).count() == 0
    assert alignment_digests(documents(spark, [None, ""])).collect()[0]["groups_sha256"] == ""


def test_the_most_frequent_pairs_of_an_id_tie(spark):
    pairs = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 1, 1), (1, 2, 1), (2, 9, 1), (1, 3, 1)], "a int, b int, n int")
    found = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in pair_counts(pairs).collect()}
    assert found == {(1, 1): (2, True), (1, 2): (2, True), (1, 3): (1, False), (2, 9): (1, True)}
