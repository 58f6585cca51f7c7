"""Scores, verdicts, digests and whole pipeline rows against plain Python, recall against all pairs, and edge cases of every operator and stage."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, html_blocks, line_crf, mixing, ngram_jaccard, passages, pii, ranking, textvec, token_scan, toxicity
from lodestone.llm.hashed import word_units

from .cases import DOCS, documents, frame
from .test_operators import bag, base_truth, jaccard_truth, leaks_truth, words

SF = "/root/testdata/sf0.001"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % n


@pytest.fixture(scope="module")
def given(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(900_000, None, "en", "s", 0), (900_001, "", "en", "s", 0), (900_002, "É\nÉ\tß !!! ABC", "en", "s", 0), (None, "a b c d e", None, None, None)], docs.schema)
    return docs.union(odd).union(docs.limit(3)).cache(), labels


# 1. N-gram Jaccard join


def links_of_all(rows):
    """(id, class, links) by counting shared 5-grams over all pairs of different sets."""
    sets = {}
    for i, t in rows:
        w = words(t)
        g = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([t or ""])
        sets.setdefault(g, []).append(i)
    nodes = list(sets)
    holders, link = defaultdict(list), defaultdict(set)
    for a, g in enumerate(nodes):
        both = Counter(b for x in g for b in holders[x])
        for b, n in both.items():
            if n >= 0.8 * (len(g) + len(nodes[b]) - n):
                link[a].add(b)
                link[b].add(a)
        for x in g:
            holders[x].append(a)
    out, seen = [], {}
    for a in range(len(nodes)):
        if a not in seen:
            todo, members = [a], {a}
            while todo:
                for b in link[todo.pop()] - members:
                    members.add(b)
                    todo.append(b)
            least = min(i for b in members for i in sets[nodes[b]])
            seen |= dict.fromkeys(members, least)
        out += [(i, seen[a], len(link[a])) for i in sets[nodes[a]]]
    return out


def test_no_link_is_lost_in_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    truth = links_of_all(rows)
    got = ngram_jaccard.jaccard_classes(docs).select("doc_id", "class_id", "n_links").collect()
    assert sum(t[2] > 0 for t in truth) > 10 and bag(got) == bag(truth)


def test_bands_find_pairs_at_the_threshold():
    """Pairs of a Jaccard of 0.80 to 0.81 share a band as often as the number of bands promises."""
    rng = np.random.default_rng(4)
    texts, pairs = [], 1500
    for _ in range(pairs):
        a = [f"w{x}" for x in rng.integers(0, 1 << 40, 364)]
        b = list(a)
        for at in range(20, 360, 40)[:8]:
            b[at] = "changed"  # five of 360 grams each: 320 shared of 400
        texts += [" ".join(a), " ".join(b)]
    batch = pa.record_batch({"text": pa.array(texts)})
    n, r = ngram_jaccard.choose_bands()
    got = np.concatenate([np.array(x.column("bands").to_pylist()) for x in ngram_jaccard._signer("text", 5, n, r)(iter([batch]))])
    assert (got[::2] == got[1::2]).any(axis=1).mean() >= 0.99


# 2. Mixing


def test_documents_are_included_at_their_rates(spark):
    sizes, draws = [1, 2, 3, 5, 8, 13, 20, 30, 40, 60, 90], 500
    rows = [(k * 100 + d, "x " * n, "en", f"s{d:04}", 0) for d in range(draws) for k, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), weights=(1,), share=0.4, most=2.0).collect()
    rate, p = defaultdict(float), {}
    for r in got:
        rate[r["size"]] += r.copies / draws
        p[r["size"]] = r.p
    assert len({round(x, 6) for x in p.values()}) == len(sizes) and sum(n * x for n, x in p.items()) == pytest.approx(0.4 * sum(sizes))
    for n in sizes:
        assert abs(rate[n] - p[n]) < 4 * math.sqrt(p[n] * (1 - p[n]) / draws) + 0.02, (n, rate[n], p[n])
    # Large documents that would be taken more than once are certain.
    certain = mixing.mix_sources(spark.createDataFrame(rows[: len(sizes)] + [(7, "y " * 2000, "en", "s0000", 0)], DOCS), weights=(1,), share=1.97).collect()
    assert {r["size"]: r.copies for r in certain}[2000] == 2 and max(r.p for r in certain) == 1


def test_mix_equals_its_sql(spark):
    docs = frame(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = con.sql(mixing.SQL.format(docs="documents")).fetchall()
    assert bag(mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()) == bag(want)


# 3. Toxicity


def test_toxicity_scores_are_the_plain_sums(spark, given):
    docs, labels = given
    model = toxicity.fit(docs, labels)
    weight = {}

    def unit(word, k):
        """Weight of a word, or of its first k bytes."""
        if (word, k) not in weight:
            raw = np.frombuffer(word, np.uint8)
            _, whole, begins = word_units(np.array([0, len(raw)]), raw, toxicity.BEGINNINGS)
            hashes = dict(zip((0, *toxicity.BEGINNINGS), [whole, *begins], strict=True))
            for j, h in hashes.items():
                weight[word, j] = float(model.weights[int(h[0]) >> (64 - toxicity.BITS)])
        return weight[word, k]

    def score(text):
        found = [w.encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
        total = sum(unit(w, k) for w in found for k in (0, *toxicity.BEGINNINGS))
        return 1 / (1 + math.exp(-(total / math.sqrt(len(found) + 4) + model.bias)))

    truth = [(i, crc(i, 3) == 1, round(score(t), 5), int(score(t) >= 0.7)) for i, t in docs.select("doc_id", "text").collect()]
    got = toxicity.score_toxicity(docs, model).collect()
    assert bag((r.doc_id, r.held_out, round(r.score, 5), r.predicted) for r in got) == bag(truth)
    assert {p for *_, p in truth} == {0, 1}


def test_held_out_labels_do_not_change_scores(spark, given):
    docs, labels = given
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (one.weights == two.weights).all() and one.bias == two.bias


# 4. Quality ranking, 10. Line rules


def plain_lines(text):
    """Per line its number of words and its features, from a whole text."""
    text = text or ""
    ws = VISIBLE.findall(text)
    tri = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    cover = {j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    out, seen, at = [], set(), 0
    for k, line in enumerate(text.split("\n")):
        raw, n = line.encode(), len(VISIBLE.findall(line))
        count = lambda table, raw=raw: sum(b in table for b in raw)
        upper, lower = set(range(65, 91)), set(range(97, 123))
        chars, w = max(len("".join(VISIBLE.findall(line))), 1), max(n, 1)
        letters = count(upper | lower | set(range(192, 256)))
        new = 1 - len([j for j in range(at, at + n) if j in cover]) / w
        x = [1, min(count(b"#*$%&|<>") / w, 3), count(upper) / max(letters, 1), min(count(b"!?=_~^@+{}[]\\") / w, 3), min(raw.count(b"|") / w, 1), count(b"0123456789") / chars, min(chars / w, 30) / 10, n < 4, n > 12, n > 0 and line in seen, n == 0, new, k == 0, min(count(b".,;:") / w, 2)]
        out.append((n, [float(np.float32(v)) for v in x]))
        seen.add(line)
        at += n
    return out, ws, len(cover)


def plain_raw(text):
    lines, ws, cover = plain_lines(text)
    raw = (text or "").encode()
    n = max(len(ws), 1)
    per = lambda j: sum(c * x[j] for c, x in lines) / n
    sizes = [len(w.encode()) for w in ws]
    mean = sum(sizes) / n
    return [
        math.log1p(len(ws)), sum(c in "#*$%&|<>" for c in text or "") / n, sum(bool(x[9]) for _, x in lines) / len(lines), cover / n, per(2), per(3), per(4), per(5), per(13), per(7), per(9),
        len({w.translate(LOW) for w in ws}) / n, mean / 10, math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0)) / 10, sum(s > 20 for s in sizes) / n, sum(b >= 128 for b in raw) / max(len(raw), 1), n / len(lines) / 100,
    ]


LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_quality(model, text):
    raw = plain_raw(text)
    z = [min(max((v - m) / s, -4), 4) for v, m, s in zip(raw, model.mean, model.spread, strict=True)]
    z += [float(v > e) for v, edges in zip(raw, model.edges, strict=True) for e in edges]
    rank = sum(a * b for a, b in zip(z, model.weights, strict=True))
    return 1 / (1 + math.exp(-((rank - model.cut) * model.scale + math.log(model.threshold / (1 - model.threshold)))))


def test_quality_scores_are_the_plain_sums(given):
    docs, labels = given
    model = ranking.fit(docs, labels)
    texts = docs.select("doc_id", "text").collect()
    truth = [(i, crc(i, 5) == 0, plain_quality(model, t)) for i, t in texts]
    got = sorted(ranking.score_quality(docs, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.score))
    want = sorted(truth, key=lambda r: (r[0] is None, r[0], r[2]))
    assert [(r.doc_id, r.held_out) for r in got] == [t[:2] for t in want]
    off = [abs(r.score - t[2]) for r, t in zip(got, want, strict=True)]
    assert np.quantile(off, 0.98) < 1e-4  # a measure that lies on a step may fall to either side
    assert all(r.predicted == int(r.score >= 0.3) for r in got) and {r.predicted for r in got} == {0, 1}
    shuffled = ranking.fit(docs.repartition(7), labels.repartition(3))
    assert (shuffled.weights == model.weights).all() and shuffled.cut == model.cut


def test_repeated_ids_do_not_depend_on_partitions(spark):
    rows = [(k % 20, f"text {k} " * (k % 9 + 1) + "###" * (k % 2), "en", "s", 0) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id bigint, quality int, toxic int")
    models = [ranking.fit(spark.createDataFrame(rows, DOCS).repartition(n), labels) for n in (1, 6)]
    assert (models[0].weights == models[1].weights).all() and models[0].cut == models[1].cut


def test_quality_learns_from_every_labelled_row_and_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 26_000  # over 20,000 of them outside the held-out fold
    good = rng.random(n) < 0.8
    texts = [" ".join(rng.choice(["ri", "stover", "AM", "quine", "ber!", "###", "a|b"], rng.integers(1, 12), p=[0.3, 0.25, 0.1, 0.2, 0.05, 0.05, 0.05] if g else [0.15, 0.1, 0.2, 0.1, 0.15, 0.15, 0.15])) for g in good]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good)], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(ranking, "BLOCK", 4096)
    model = ranking.fit(docs, labels)
    train = np.array([crc(k, 5) != 0 for k in range(n)])
    assert train.sum() > 20_000
    data = [t.encode() for t, m in zip(texts, train, strict=True) if m]
    raw = ranking.raw_features(np.concatenate([[0], np.cumsum([len(t) for t in data])]), np.frombuffer(b"".join(data), np.uint8))
    y = good[train]
    assert np.allclose(model.mean, raw.mean(axis=0), rtol=1e-9) and np.allclose(model.spread, np.where(raw.std(axis=0) > 1e-9, raw.std(axis=0), 1))
    qs = np.linspace(0.02, 0.98, ranking.STEPS)
    assert np.allclose(model.edges, np.concatenate([np.quantile(raw[m], qs, axis=0) for m in (y, ~y)]).T, rtol=1e-12)
    # At the least loss over all pairs its gradient is none.
    x = model.expand(raw)
    s = x @ model.weights
    pull, push = np.zeros(y.sum()), np.zeros((~y).sum())
    for a in range(0, len(pull), 1000):
        part = 1 / (1 + np.exp(s[y][a : a + 1000, None] - s[~y][None]))
        pull[a : a + 1000] = part.mean(axis=1)
        push += part.sum(axis=0) / len(pull)
    gradient = push @ x[~y] / len(push) - pull @ x[y] / len(pull) + 2e-4 * model.weights
    assert np.abs(gradient).max() < 1e-5
    ranked, k = np.sort(s), (~y).mean() * len(y)
    near = ranked[int(k - 0.01 * len(y)) - 1 : int(k + 0.01 * len(y)) + 3]
    at = np.diff(near).argmax()
    assert abs(model.cut - (near[at] + near[at + 1]) / 2) < 1e-9
    assert abs(model.scale * (np.quantile(s, 0.9) - np.quantile(s, 0.02)) - 8) < 1e-9


def test_order_statistics_are_those_of_the_sorted_values():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=500), rng.integers(-3, 3, 400), [0.0, -0.0, 1e-310, -1e-310, 1e300, -1e300, np.inf, -np.inf]])
    parts = np.array_split(rng.permutation(values), 5)
    sweep = lambda work, add=False: sum(got) if (got := [work(None, p) for p in parts]) and add else got
    for bits in (8, 16):
        assert (ranking.order_statistics(sweep, lambda _, p: [p], np.arange(len(values))[None, ::9], bits) == np.sort(values)[None, ::9]).all()


def test_verdicts_on_lines_are_the_plain_best_paths(given):
    docs, _ = given
    w, tr = line_crf.train()
    w, tr = w.astype(float), tr.astype(float)

    def kept(text):
        lines, ws, cover = plain_lines(text)
        best = []
        for k, (_, x) in enumerate(lines):
            emit = [sum(a * b for a, b in zip(x, w[:, y], strict=True)) for y in (0, 1)]
            best.append([(emit[y], -1) if not k else max((best[-1][q][0] + tr[q, y] + emit[y], q) for q in (0, 1)) for y in (0, 1)])
        y, content = int(best[-1][1][0] > best[-1][0][0]), 0
        for k in range(len(lines) - 1, -1, -1):
            content += lines[k][0] * y
            y = best[k][y][1]
        return len(ws) >= 50 and 100 * cover <= 50 * len(ws) and content / max(len(ws), 1) >= 0.5

    truth = bag((i, kept(t)) for i, t in docs.select("doc_id", "text").collect())
    assert bag(line_crf.judge_lines(docs).select("doc_id", "kept").collect()) == truth and len({k for _, k in truth}) == 2


# 9. Personal data


def test_digests_of_personal_data(given):
    docs, _ = given
    truth = []
    for i, t in docs.select("doc_id", "text").collect():
        found = base_truth(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in found[k])
        truth.append((i, *(len(found[k]) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest(), joined))
    got = pii.find_personal_data(docs).collect()
    assert bag(tuple(r)[:6] for r in got) == bag(t[:6] for t in truth)
    assert bag((r.doc_id, ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS)) for r in got) == bag((t[0], t[6]) for t in truth)
    assert sum(t[1] + t[4] for t in truth) > 5


def test_long_addresses_are_found_whole():
    for n in (5, 60, 400):
        text = f"lives at 12 {'a' * n} {'b' * n} street, near"
        assert [text[a:b] for a, b in pii.find_spans(text)["address"]] == [text[9:-6]]


@pytest.mark.parametrize("text", ["://" * 30_000, "tel:" * 30_000 + "." * 30_000, "1" * 300_000, "1." * 100_000, "a@" * 50_000, "rue " * 50_000, ("a" * 40 + " ") * 5_000 + " street" * 5_000, "+1" * 50_000])
def test_hard_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - began < 5


# Edge cases of all


CLASHING = ("id", "_id", "k", "_k", "_repeats", "row_key", "a.b", "text2", "h", "c0", "c1", "node", "s", "_key", "_text")


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(k, *r[1:], *(f"{c}{k}" for c in CLASHING)) for k, r in enumerate(documents())], DOCS + "".join(f", `{c}` string" for c in CLASHING))
    bench = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    every = bag(map(tuple, docs.collect()))
    model = ranking.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    for out, n in ((ngram_jaccard.keep_one(docs), None), (ranking.filter_quality(docs, model), None), (decontaminate.decontaminated(docs, bench), None)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and not bag(map(tuple, rows)) - every
    red = pii.redact(docs, length_col="n_chars")
    assert red.columns == docs.columns and red.count() == docs.count()
    for out in (toxicity.score_toxicity(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))), passages.repeated_passages(docs), token_scan.count_tokens(docs), pii.find_personal_data(docs), line_crf.judge_lines(docs), mixing.mix_sources(docs), decontaminate.find_hits(docs, bench), ngram_jaccard.jaccard_classes(docs)):
        assert out.count() == docs.count()


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    labels, bench = spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), spark.createDataFrame([], "item_id bigint, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert ranking.score_quality(docs, ranking.fit(docs, labels)).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).count() == 0
    assert pii.find_personal_data(docs).count() == decontaminate.find_hits(docs, bench).count() == mixing.mix_sources(docs).count() == 0
    assert html_blocks.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    # No benchmark and no labels leave the documents as they are.
    assert decontaminate.decontaminated(frame(spark), bench).count() == len(documents())


def test_a_long_text_is_read_in_portions(spark, monkeypatch):
    """Whatever the size of the portions and of the tables of powers, hashes and results are the same."""
    rng = np.random.default_rng(8)
    text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 30_000))
    rows = [(1, text, "en", "s", 0), (2, text[:90_000] + " tail " * 50, "en", "s", 0), (3, "head " + text[40_000:140_000], "en", "s", 0)]
    want = bag(passages.digest(passages.repeated_passages(frame(spark, rows, extra=False))).collect())
    monkeypatch.setattr(passages, "PORTION", 10_000)
    assert bag(passages.digest(passages.repeated_passages(frame(spark, rows, extra=False))).collect()) == want
    raw = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(raw)])
    before = textvec.text_words(off, raw)[3], line_crf.measure(off, raw), ranking.raw_features(off, raw)
    monkeypatch.setattr(textvec, "AT_ONCE", 1 << 12)
    monkeypatch.setattr(textvec, "_POWERS", textvec._POWERS[: 1 << 12])
    monkeypatch.setattr(textvec, "_INVERSE", textvec._INVERSE[: 1 << 12])
    after = textvec.text_words(off, raw)[3], line_crf.measure(off, raw), ranking.raw_features(off, raw)
    assert (before[0] == after[0]).all() and (before[2] == after[2]).all() and all((before[1][k] == after[1][k]).all() for k in before[1])
    s = textvec.prefix(raw)
    at = np.arange(0, len(raw) - 10, 997)
    assert (textvec.range_hash(s, at, at + 10) == np.concatenate([textvec.range_hash(textvec.prefix(raw[a : a + 10]), np.array([0]), np.array([10])) for a in at])).all()


# The pipeline


def test_pipeline_rows(spark, tmp_path):
    rows = {}
    for r in [*documents(9), *((300 + k, " ".join(f"w{j % (60 + k)}###" for j in range(80 + k)), "en", "s1", 0) for k in range(30)), (400, PERSONAL, "en", "s2", 5)]:
        rows.setdefault(r[0], r)
    rows = [r for i, r in rows.items() if i is not None]
    text = next(r[1] for r in rows if r[1] and 60 < len(r[1].split()) < 200)
    bench = [(1, " ".join(text.split()[:12])), (2, " ".join(text.split()[10:24])), (3, None)]
    labels = [(r[0], int("###" not in (r[1] or "")), 0) for r in rows]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")

    model = ranking.fit(docs, lab)
    good = [r for r in rows if plain_quality(model, r[1]) >= 0.3]
    assert 0 < len(good) < len(rows)
    least = {t[1] for t in jaccard_truth(good)}
    one = [r for r in good if r[0] in least]
    assert len(one) < len(good)
    bad = {t[0] for t in leaks_truth(one, bench) if t[5]}
    clean = [r for r in one if r[0] not in bad]
    assert len(clean) < len(one)
    plain = [(r[0], None if r[1] is None else pii.redacted(r[1], pii.find_spans(r[1])), r[3]) for r in clean]
    assert plain != [(r[0], r[1], r[3]) for r in clean]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", plain)
    want = con.sql(f"SELECT doc_id, size, target, taken // size AS copies, taken FROM ({mixing.SQL.format(docs='documents')}) WHERE taken > 0").fetchall()
    source = {i: s for i, _, s in plain}
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "size", "target", "copies", "taken").collect()
    assert bag(got) == bag((i, source[i], n, t, c, k) for i, n, t, c, k in want)


PERSONAL = "Write to jane.roe@example.org or call +1 (555) 210-3344 before noon. " + " ".join(f"quiet{k} lantern orchard velvet meadow" for k in range(30)) + "."
