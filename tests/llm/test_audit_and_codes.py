"""Filter audit, SentencePiece codes and product codes against plain versions, with the odd tables every operator must take."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import filter_audit, piece_codes, product_codes, queries

from .cases import DOCS, frame

SF = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


def rows_of(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# 11. Filter interaction audit


def audit_truth(docs, labels):
    """Every order applied document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails.append((lang or "", f + "E" * (i is not None and first[t] < i), i))
    out, removed = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for k, x in enumerate(order):
            for part in {p for p, _, _ in fails}:
                here = [(f, i) for p, f, i in fails if p == part]
                gone = [any(y in f for y in order[:k]) for f, _ in here]
                hit = [(f, i) for (f, i), g in zip(here, gone, strict=True) if x in f and not g]
                out[part, order, k + 1] = [sum(not g and x not in f for (f, _), g in zip(here, gone, strict=True)), len(hit), sum(g and x in f for (f, _), g in zip(here, gone, strict=True)), sum(f == x for f, _ in here), sum(i in good for _, i in hit), sum(i in toxic for _, i in hit)]
                removed[part, x] += len(hit)
    return {(*key, *v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_every_order_document_by_document(spark):
    docs = [(k, f"T{k % 3} " * (k % 9 * 40) + "#" * (k % 4 == 0) + "word list of some length " * (k % 5) + " ".join(f"w{j}" for j in range(k % 2 * 250)), ["en", "de", None, ""][k % 4], None, 0) for k in range(40)]
    docs += [(k, docs[k % 7][1], "en", None, 0) for k in range(40, 60)] + [docs[0], docs[30], (None, docs[1][1], "de", None, 0), (None, None, "de", None, 0), (61, None, None, None, 0), (62, "", "fr", None, 0)]
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 70, 2)] + [(1, None, 1), (1, 1, None), (None, 1, 1), (3, None, None)]
    got = filter_audit.audit_filters(spark.createDataFrame(docs, DOCS).withColumn("mask", filter_audit.F.lit("x")).withColumn("hash", filter_audit.F.lit(1)).withColumn("id", filter_audit.F.lit(1)).repartition(3), spark.createDataFrame(labels, LABELS))
    assert {tuple(r) for r in got.collect()} == audit_truth(docs, labels)
    assert got.count() == len({d[2] or "" for d in docs}) * 600


def test_audit_equals_its_sql(spark):
    con = duckdb.connect()
    docs, labels = frame(spark), spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(30)], LABELS)
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas())
    got = filter_audit.audit_filters(docs, labels)
    cols = got.columns
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(f"SELECT {', '.join(cols)} FROM ({filter_audit.SQL.format(docs='documents', labels='labels')})").fetchall())
    assert not filter_audit.audit_filters(frame(spark, []), labels).count()


# 12. SentencePiece


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_codes.MODEL)


PARTS = ["a", "th", "e", "ing", " ", "  ", " " * 7, piece_codes.SPACE, "\n", "\t", "é", "融", "😀", "1", "23", "\0", "ß", " the", "xx", "�", "'", "http://"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=30).map("".join))
def test_encoding_and_decoding_equal_the_library(text):
    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    ids = LIBRARY.encode(text, add_eos=True)
    m = piece_codes.model()
    assert list(m.encode(text)) == ids and m.decode(np.array(ids)) == LIBRARY.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2]) | st.integers(3, 258) | st.integers(3, 31_999), max_size=10))
def test_any_ids_decode_like_the_library(ids):
    assert piece_codes.model().decode(np.array(ids, int)) == LIBRARY.decode(ids)


def test_backtracking_gives_what_merging_gives():
    """Whole texts as one stretch, so that pieces are taken back often."""
    m = piece_codes.model()
    rng = np.random.default_rng(3)
    pieces = [p for p in m.score if p.isalpha() and len(p) < 5][:300]
    for _ in range(400):
        text = "".join(rng.choice(pieces, 40))
        assert [m.piece[k] for k in m.pieces(text)] == m.merged(text)
    spaces = piece_codes.SPACE * 50 + "x"
    assert [m.piece[k] for k in m.pieces(spaces)] == m.merged(spaces)


def test_stretches_cut_anywhere_change_nothing(monkeypatch):
    text = " the quick  brown\nfox " * 300 + "   end"
    monkeypatch.setattr(piece_codes, "AT_ONCE", 37)
    monkeypatch.setattr(piece_codes, "REMEMBERED", 5)
    assert list(piece_codes.model().encode(text)) == LIBRARY.encode(text, add_eos=True)
    long = "ab" * 40_000 + " " * 3000 + "é" * 2000
    assert list(piece_codes.model().encode(long)) == LIBRARY.encode(long, add_eos=True)


def test_op12_equals_the_library(spark):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = Counter()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, t in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))] += 1
    assert rows_of(queries.QUERIES["op12_piece_codes"](spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_piece_codes_take_odd_tables(spark):
    df = frame(spark).withColumn("ids", filter_audit.F.lit("x"))
    got = piece_codes.decode_ids(piece_codes.encode_texts(df)).collect()
    want = Counter((i, t or "") for i, t in df.select("doc_id", "text").collect())
    assert Counter((r.id, r.text) for r in got) == want and all(r.ids[-1] == 2 for r in got)
    assert {tuple(r.ids) for r in got if r.text == ""} == {(2,)}
    assert not piece_codes.digest(piece_codes.decode_ids(piece_codes.encode_texts(frame(spark, [])))).count()
    none = spark.createDataFrame([(1, None), (2, [])], "id int, ids array<int>")
    assert [tuple(r) for r in piece_codes.decode_ids(none).orderBy("id").collect()] == [(1, [], ""), (2, [], "")]


# 13. Product codes


def codes_truth(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    part = [np.array([v[p * size : (p + 1) * size] for _, v, _ in kept]) for p in range(parts)]
    books = [x[:entries].copy() for x in part]

    def assign(x, b):
        d = ((x[:, None, :] - b[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for x, b in zip(part, books, strict=True):
            a, _ = assign(x, b)
            for k in set(a.tolist()):
                b[k] = x[a == k].sum(axis=0) // (a == k).sum()
    last = [assign(x, b) for x, b in zip(part, books, strict=True)]
    codes = ["".join(f"{a[k]:02x}" for a, _ in last) for k in range(len(kept))]
    error = sum(d for _, d in last)
    by_label = Counter()
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return Counter((i, c, int(e), by_label[lab], sha) for (i, _, lab), c, e in zip(kept, codes, error, strict=True))


CODE_COLS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_op13_equals_complete_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(queries.QUERIES["op13_product_codes"](spark, SF), *CODE_COLS) == codes_truth(rows)


@pytest.mark.parametrize("spread", [0.5, 3.0, 60_000.0])
def test_partial_distances_lose_no_entry(spread):
    """Ties, repeats, values beyond exact floating point, few and many dimensions."""
    rng = np.random.default_rng(5)
    for dim in (1, 3, 8, 16, 50):
        x = product_codes.integers(rng.normal(0, spread, (700, dim)).round(1), 1024)
        book = np.concatenate([x[:100], x[:20], x[50:60] + 1])
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        entry, best = product_codes.nearest(x, book)
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_product_codes_take_odd_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(k // 2, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8).round(1)], None if k % 5 == 0 else k % 3) for k in range(600)]
    rows += [(900, None, 1), (901, [0.1, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None), rows[5], rows[5]]
    rows += [(-5, [float("-inf")] + [0.0] * 7, 0), (-4, None, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("v", filter_audit.F.lit("x")).withColumn("id", filter_audit.F.lit("x")).withColumn("error", filter_audit.F.lit(2)).repartition(5)
    assert rows_of(product_codes.compress(df), *CODE_COLS) == codes_truth(rows)
    # Labels joined by a shuffle give the same.
    product_codes.BROADCAST_LABELS, kept = 1, product_codes.BROADCAST_LABELS
    try:
        assert rows_of(product_codes.compress(df), *CODE_COLS) == codes_truth(rows)
    finally:
        product_codes.BROADCAST_LABELS = kept
    few = df.where("vec_id between 3 and 9")
    assert rows_of(product_codes.compress(few), *CODE_COLS) == codes_truth([r for r in rows if r[0] is not None and 3 <= r[0] <= 9])
    assert not product_codes.compress(df.where("false")).count() and not product_codes.compress(df.where("vec_id > 899")).count()
    with pytest.raises(ValueError):
        product_codes.train(df, parts=3)
    # Vectors of another length are left out; huge components stop at the limit.
    other = spark.createDataFrame([(1, [1.0] * 8, 0), (2, [1.0] * 4, 0), (3, [], 0), (4, [1e30] + [0.0] * 7, 0)], df.select("vec_id", "embedding", "label").schema)
    assert {r.vec_id for r in product_codes.compress(other).collect()} == {1, 4}


# 5. HTML extraction


@pytest.mark.parametrize("depth", [200, 255, 256, 257, 300, 5_000, 100_000])
def test_deep_nesting_closes_nothing_outside(depth):
    """Elements past the depth whose names are kept are closed by their own end tags."""
    from lodestone.llm.html_blocks import blocks_of

    page = "<html><body><article><div><p>before</p>" + "<div>" * depth + "deep" + "</div>" * depth + "<p>after</p></div><p>last</p></article><footer>foot</footer></body></html>"
    outside = [(t, path) for t, path, _ in blocks_of(page) if t != "deep"]
    assert outside == [("before", ("html", "body", "article", "div", "p")), ("after", ("html", "body", "article", "div", "p")), ("last", ("html", "body", "article", "p")), ("foot", ("html", "body", "footer"))]


def test_many_open_elements_stay_fast():
    import time

    from lodestone.llm.html_blocks import blocks_of

    began = time.perf_counter()
    assert len(blocks_of("<span>" * 30_000 + "<div>x</div>" * 30_000)) == 30_000
    assert blocks_of("<u><div>" + "<b>" * 30_000 + "</u>x" * 30_000)[0][0] == "x" * 30_000
    assert time.perf_counter() - began < 60


# 9. Personal data


def test_account_numbers_end_at_the_length_of_their_country():
    """Made numbers of every registered length, with a word after them that also makes the check digits right."""
    from lodestone.llm.pii import IBAN_LENGTHS, _iban_end, iban

    assert len(IBAN_LENGTHS) > 80
    for country, n in IBAN_LENGTHS.items():
        body = ("1234567890" * 4)[: n - 4]
        rest = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        number = f"{country}{98 - rest:02}{body}"
        assert iban(number) and len(number) == n
        tail = next(f" {k:03}" for k in range(1000) if iban(f"{number}{k:03}")) if n <= 31 else ""
        assert _iban_end(number + tail, 0, len(number + tail)) == n
