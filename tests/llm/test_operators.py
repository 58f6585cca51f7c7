"""Every operator against a plain version of itself on small tables."""

import hashlib
import html
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, html_blocks, line_crf, lyndon, mixing, ngram_jaccard, passages, pii, ranking, textvec, token_scan, toxicity
from lodestone.llm.components import components

from .cases import DOCS, documents, frame

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 3), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# 1. N-gram Jaccard join


def jaccard_truth(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([t or ""]))
    nodes = sorted(set(sets), key=str)
    link = {a: {b for b in nodes if a is not b and len(a & b) >= 0.8 * len(a | b)} for a in nodes}
    out = []
    for r, s in zip(rows, sets, strict=True):
        seen, todo = {s}, [s]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [q[0] for q, t in zip(rows, sets, strict=True) if t in seen and q[0] is not None]
        out.append((r[0], min(ids, default=None), len(link[s]), sets.count(s), min(map(str, seen))))
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard(spark, block):
    rows = documents()
    got = ngram_jaccard.jaccard_classes(frame(spark), block=block).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert bag(got) == bag(t[:4] for t in jaccard_truth(rows))


def test_jaccard_keeps_one_of_each_class(spark):
    rows = documents()
    kept = ngram_jaccard.keep_one(frame(spark, extra=False)).collect()
    classes = {t[4]: t[1] for t in jaccard_truth(rows)}
    assert sorted(r.doc_id for r in kept) == sorted(classes.values())
    assert list(kept[0].asDict()) == [c.split()[0] for c in DOCS.split(", ")]
    assert ngram_jaccard.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_bands_reach_their_recall():
    b, r = ngram_jaccard.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 > 1 - (1 - 0.8**r) ** (b - 1)


# 2. Mixing


def test_targets_are_reshared(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 10, None: 400}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * left / total > 2 * sizes[s] + 1e-9}
        if not over:
            target |= {s: w[s] * left / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert got == pytest.approx(target)


def test_mix(spark):
    rows = documents()
    df = frame(spark)
    got = mixing.mix_sources(df).collect()
    assert bag((r.doc_id, r.source) for r in got) == bag((r[0], r[3]) for r in rows)
    size = bag((r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    assert bag((r.doc_id, r.source, r["size"]) for r in got) == size
    assert all(r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        most = max(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= most
    assert bag(mixing.mix_sources(df.repartition(5)).collect()) == bag(got)
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


# 3. Toxicity


def _labelled(n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 8 == 0
        ws = [f"w{rng.integers(3000)}x" for _ in range(rng.integers(15, 80))]
        if toxic:
            for _ in range(4):
                ws[rng.integers(len(ws))] = rng.choice(["idiot", "scum"]) if k % 16 else f"zorba{rng.integers(50)}"
        rows.append((k, " ".join(ws), "en", "s", 1))
        labels.append((k, 1 - k % 5 // 4, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _labelled()
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", None, None, None), rows[0]], DOCS)
    lab = spark.createDataFrame([*labels, (5000, None, None), labels[1]], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {k: t for k, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.score_toxicity(docs.limit(5), empty).count() == 5
    assert toxicity.score_toxicity(spark.createDataFrame([], DOCS), model).count() == 0


def test_only_near_copies_count_once():
    rng = np.random.default_rng(3)
    sets = [rng.choice(400, rng.integers(0, 40), replace=False).astype(np.uint64) for _ in range(60)]
    sets += [s[rng.random(len(s)) < 0.9] for s in sets[:40]] + [s[::-1] for s in sets[:5]]
    share = lambda a, b: len(np.intersect1d(a, b)) / max(len(np.union1d(a, b)), 1)
    truth = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if share(a, b) >= 0.8 or not len(a) and not len(b):
                truth = [truth[j] if t == truth[i] else t for t in truth]
    got = toxicity.near_copies(sets)
    assert len(set(got)) == len(set(truth)) == len(set(zip(got, truth, strict=True)))
    assert len(toxicity.near_copies([])) == 0


def test_texts_with_one_common_word_are_mined_apart(spark):
    names = tuple(f"c{k}" for k in range(100_000))
    raw = np.frombuffer(" ".join(names).encode(), np.uint8)
    whole = textvec.text_words(np.array([0, len(raw)]), raw)[3]
    common = names[int(textvec.mix(whole ^ np.uint64(0xA24BAED4963EE407)).argmin())]  # the least hash of each text is this word's
    docs = [(k, " ".join([common, *(f"w{k}x{j}" for j in range(20)), *(["zorba"] if k % 2 else [])]), "en", "s", 1) for k in range(80)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, DOCS), labels, held=3)
    assert toxicity._hash_words(("zorba",))[0] in model.lexicons.mined[0]


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.8])
    v = np.where(rng.random((6000, 4)) < right, y[:, None], ~y[:, None]).astype(np.int8)
    follows = rng.random(6000) < 0.5  # a voter that often repeats the first one
    v = np.hstack([v, np.where(follows, v[:, 0], np.where(rng.random(6000) < 0.8, y, ~y)).astype(np.int8)[:, None]])
    pat, n = np.unique(v, axis=0, return_counts=True)
    m = toxicity.fit_label_model(pat, n)
    assert np.abs(m.accuracies(pat, n)[:4] - right).max() < 0.06
    assert m.parent[4] == 0 or m.parent[0] == 4
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.93


# 4. Quality ranking


def test_quality(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(300):
        good = k % 6 != 0
        ws = [f"{rng.choice(['ri', 'sto', 'am', 'qui'])}{rng.choice(['ver', 'ne', 'ber', 'et'])}{'' if good else rng.choice(['###', '$$$'])}" for _ in range(rng.integers(20, 90))]
        rows.append((k, " ".join(ws) + ".", "en", "s", 1))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), rows[0]], DOCS)
    model = ranking.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = ranking.score_quality(docs, model).collect()
    assert len(got) == 302 and all(r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == labels[r.doc_id][1] for r in got if r.held_out and r.doc_id < 300)
    kept = ranking.filter_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {k for k, q, _ in labels if q}
    one = ranking.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert ranking.filter_quality(docs, one).count() == 302


# 5. HTML


@pytest.fixture(scope="module")
def net():
    return html_blocks.train(pages=250, epochs=6)


def test_html_labels_most_blocks(net):
    rng = np.random.default_rng(77)
    pages = [html_blocks._marked(*html_blocks.example_page(rng)) for _ in range(60)]
    got = net.label([b for b, _ in pages])
    assert np.mean(np.concatenate([a == (y > 0) for a, (_, y) in zip(got, pages, strict=True)])) > 0.95


def test_html_blocks():
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><p>a &amp; b\n c<br>d<p>e<div>f<b>g</b></div><!-- x --><ul><li>h<li>i</ul>&#233;&nbsp;j <textarea>no</textarea></body>"
    assert [b[0] for b in html_blocks.blocks_of(page)] == ["a & b c d", "e", "fg", "h", "i", "é j"]
    assert html_blocks.blocks_of("") == [] and html_blocks.blocks_of("<p") == []
    assert html_blocks.blocks_of("plain &am text")[0][0] == html.unescape("plain &am text")


def test_broken_and_endless_markup():
    texts = lambda page: [b[0] for b in html_blocks.blocks_of(page)]
    assert texts('<p class="x>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>a<svg>b<p>c") == ["ab", "c"] and texts("<p>a<math>b</math>c") == ["abc"]
    assert texts("<p>a<script>b<p>c") == ["a"] and texts("a < b <") == ["a < b <"]
    assert len(texts("<div>x" * 3000)) == 3000
    for page in ("<a " * 40_000, "<p>" + "<b>x</b>" * 40_000, '<p title="x>y</p>' * 40_000, "<i>" * 1000 + "</b>" * 40_000, "< " * 100_000, "<svg>x" * 40_000):
        began = time.perf_counter()
        texts(page)
        assert time.perf_counter() - began < 5


def test_portions_of_a_page_give_the_labels_of_the_whole():
    net = html_blocks.trained()
    rng = np.random.default_rng(12)
    pages = [html_blocks.blocks_of(html_blocks.example_page(rng)[0]) for _ in range(40)]
    pages.append([b for p in pages for b in p])
    whole = net.label(pages)
    logits = [net.run([html_blocks.vectors(p)])[0] for p in pages]
    states = html_blocks.Labeller.states
    html_blocks.Labeller.states = lambda self, part, d, x: states(self, part, d, None, portion=7)
    try:
        parts = net.label(pages, cells=300)
    finally:
        html_blocks.Labeller.states = states
    for a, b, z in zip(whole, parts, logits, strict=True):
        clear = np.abs(z) > 1e-3
        assert (a == b)[clear].all() and (a == (z > 0))[clear].all()


def test_the_kept_weights_label_articles(spark):
    """Held against the text that each made page was made from."""
    rng = np.random.default_rng(4321)
    made = [html_blocks.example_page(rng) for _ in range(150)]
    got = html_blocks.extract_text(spark.createDataFrame([(k, "u", p) for k, (p, _) in enumerate(made)], "page_id bigint, url string, html string")).collect()
    right = total = 0
    for r in got:
        have, want = Counter(r.text.split("\n")), Counter(" ".join(t.split()) for t in made[r.page_id][1])
        right, total = right + sum((have & want).values()), total + sum((have | want).values())
    assert right / total > 0.97
    assert html_blocks.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_lstm_gradients_are_right():
    rng = np.random.default_rng(5)
    data = [html_blocks._marked(*html_blocks.example_page(rng)) for _ in range(3)]
    pages, y = [html_blocks.vectors(b) for b, _ in data], np.concatenate([t for _, t in data])
    net = html_blocks.Labeller(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = net.gradients(pages, y)
    for k in ("uf", "ub", "out", "inf"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old, eps = net.p[k][at], 1e-3
        net.p[k][at] = old + eps
        up, _ = net.gradients(pages, y)
        net.p[k][at] = old - eps
        down, _ = net.gradients(pages, y)
        net.p[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(grad[k][at]), rel=0.05)


def test_html_query(spark, monkeypatch, net):
    monkeypatch.setattr(html_blocks, "trained", lambda: net)
    rng = np.random.default_rng(8)
    rows = [(k, "u", html_blocks.example_page(rng)[0]) for k in range(5)] + [(9, None, None), (9, "v", ""), (9, "v", "")]
    got = html_blocks.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 9] == ["", "", ""]


# 6. Suffix-array dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=5), st.integers(1, 3))
def test_suffix_arrays(texts, times):
    texts = [t * times for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = lyndon.suffix_arrays(np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64), first)
    for k, t in enumerate(texts):
        assert (got[first[k] : first[k + 1]] - first[k]).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def passages_truth(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    raw = [(r[1] or "").encode() for r in rows]
    first = {}
    for rank, k in enumerate(order):
        for s in range(len(raw[k]) - length + 1):
            first.setdefault(raw[k][s : s + length], (rank, s))
    out = []
    for rank, k in enumerate(order):
        b, spans = raw[k], []
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] != (rank, s):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        out.append((rows[k][0], len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "split"), [(100, 36, 2048), (30, 12, 2048), (30, 12, 1), (12, 6, 1)])
def test_passages(spark, monkeypatch, length, gram, split):
    rows = [r for r in documents(3) if r[0] is not None and not (r[0] == 5 and r[4] == 3)]
    shared = "a passage that many texts share, word for word, and that is long enough to be found as such by all"
    rows += [(100 + k, f"{'x' * k} start {k} {shared}{k % 3} end {shared[: 40 + k]}", "en", "s", 0) for k in range(9)]
    rows += [(200, "ab" * 150, "en", "s", 0), (201, "a" * 260, "en", "s", 0), (202, "ab" * 80 + "a" * 120, "en", "s", 0)]
    monkeypatch.setattr(passages, "SPLIT", split)
    monkeypatch.setattr(passages, "TOGETHER", 400_000 if split > 1 else 50)
    got = passages.digest(passages.repeated_passages(frame(spark, rows), length=length, gram=gram)).collect()
    assert bag(got) == bag(passages_truth(rows, length))


def test_a_phrase_in_many_surroundings_is_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    raw = letters(100_000)
    at = np.arange(len(raw) - 35)
    k = int(textvec.range_hash(textvec.prefix(np.frombuffer(raw.encode(), np.uint8), textvec.EXACT), at, at + 36).argmin())
    phrase = raw[k : k + 36]  # of so small a hash that it is the anchor of all windows around it
    rows = [(j, letters(150) + phrase + letters(150), "en", "s", 0) for j in range(60)]
    rows += [(100 + j, letters(90) + rows[j][1][100:230] + letters(90), "en", "s", 0) for j in range(5)]
    solve = passages._solve

    def spied(length, gram):
        run = solve(length, gram)

        def counted(batches):
            batches = list(batches)
            most = max((np.unique(b.column(0).to_numpy(), return_counts=True)[1].max() for b in batches if b.num_rows), default=0)
            assert most <= 8, f"{most} contexts in one group"
            return run(iter(batches))

        return counted

    monkeypatch.setattr(passages, "SPLIT", 8)
    monkeypatch.setattr(passages, "_solve", spied)
    got = passages.digest(passages.repeated_passages(frame(spark, rows))).collect()
    assert bag(got) == bag(passages_truth(rows, 100)) and sum(r.n_removed > 0 for r in got) == 5


def test_passages_of_nothing(spark):
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_repeat_each_other(spark):
    text = "z" + documents()[0][1] if documents()[0][1] else "q" * 150
    text = (text + " ") * 20
    rows = [(1, text, "en", "s", 0)] * 3 + [(None, text, "en", "s", 0)]
    got = passages.digest(passages.repeated_passages(frame(spark, rows))).collect()
    whole = [r for r in got if r.n_removed == r.n_bytes]
    assert len(got) == 4 and len(whole) == 3


# 7. Decontamination


def leaks_truth(rows, bench):
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        k = min(8, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s : s + k])].add(item)
    out = []
    for r in rows:
        w, hit, items = words(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if of := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    items |= of
        named = sorted(str(i) for i in items if i is not None)
        out.append((r[0], len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), len(named) >= 2))
    return out


@pytest.mark.parametrize("bounds", [{}, {"max_windows": 0}, {"max_anchors": 0}])
def test_decontamination(spark, bounds):
    rows = documents(5)
    long = [r[1] for r in rows if r[1] and len(words(r[1])) > 40]
    bench = [(1, " ".join(words(long[0])[3:20])), (2, long[0].upper()), (3, "One"), (4, None), (5, "..."), (12, " ".join(words(long[1])[10:18])), (13, "c d")]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.find_hits(frame(spark, rows), b, **bounds)).collect()
    truth = leaks_truth(rows, bench)
    assert bag(got) == bag(truth) and any(t[5] for t in truth)
    if not bounds:
        left = decontaminate.decontaminated(frame(spark, rows), b)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((t[0] is None, t[0] or 0) for t in truth if not t[5])
        cutout = decontaminate.removed_spans(frame(spark, rows), b).collect()
        assert bag((r.id, len(r.words) - len(r.kept)) for r in cutout) == bag((t[0], t[2]) for t in truth)
        none = spark.createDataFrame([], "item_id bigint, text string")
        assert decontaminate.decontaminated(frame(spark, rows), none).count() == len(rows)
        assert decontaminate.find_hits(spark.createDataFrame([], DOCS), b).count() == 0


# 8. Token counts


def test_tokens(spark):
    rows = documents()
    got = token_scan.count_tokens(frame(spark), block=64).collect()
    enc = token_scan.encoder(f"{token_scan.TOKENIZER_DIR}/{token_scan.VOCABULARY}")
    assert bag((r.doc_id, r.n_tokens) for r in got) == bag((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.file].append(r)
    for rs in by.values():
        at = 0
        for k, r in enumerate(sorted(rs, key=lambda r: r.ordinal)):
            assert (r.ordinal, r.start) == (k, at)
            at += r.n_tokens + 1
    assert token_scan.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    truth = []
    for f in range(3):
        t = rng.integers(0, 5, 500).astype("<u2")
        t[rng.random(500) < 0.1] = 9
        if f == 2:
            t[:] = 1
        t.tofile(tmp_path / f"{f}.bin")
        at = [-1, *np.flatnonzero(t == 9).tolist()]
        truth += [b - a - 1 for a, b in zip(at, at[1:], strict=False)] + ([499 - at[-1]] if at[-1] < 499 else [])
    (tmp_path / "empty.bin").touch()
    (tmp_path / "torn.bin").write_bytes(np.array([3, 9, 9, 4, 9], "<u2").tobytes() + b"\x09")
    truth += [1, 0, 1]
    got = token_scan.scan_blocks(token_scan.read_token_files(spark, str(tmp_path), block=37), end=9).collect()
    assert Counter(n for r in got for n in r.n_tokens) == Counter(truth)


# 9. Personal data

PII = "mail me: a.b+c@ex-a.co.uk, x@y@b.c. 10.0.0.256 1.2.3.4.5 call +49 (30) 1234-5678 or +1 2 4111 1111 1111 1111 then 4111-1111-1111-1112 é@é.é +123456789012345678 IBAN DE89370400440532013000 at 12 Long Oak Street; rue de la Paix 5, mailto:q@w.ee"


def base_truth(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    }
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "b-c", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "é", "\n", "_", "%"]), max_size=40).map("".join))
def test_base_spans_are_the_patterns(text):
    got = pii.find_spans(text)
    assert {k: got[k] for k in pii.BASE_KINDS} == base_truth(text)


@pytest.mark.parametrize("number", ["ES9121000418450200051332", "AT611904300234573201", "AT61 1904 3002 3457 3201", "BE68539007547034", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"])
def test_accounts_end_before_words(number):
    for after in ("", " for the rent", " is my account", " with love", " banana", " a", ", paid"):
        text = f"pay {number}{after}"
        assert [text[a:b] for a, b in pii.find_spans(text)["account"]] == [number]
        assert pii.redacted(text, pii.find_spans(text)) == f"pay <account>{after}"
    assert pii.find_spans(f"pay {number[:-1]}{(int(number[-1]) + 1) % 10} for the rent")["account"] == []


def test_pii(spark):
    got = pii.find_spans(PII)
    assert {k: got[k] for k in pii.BASE_KINDS} == base_truth(PII)
    assert [PII[a:b] for a, b in got["account"]] == ["DE89370400440532013000"]
    assert [PII[a:b] for a, b in got["address"]] == ["12 Long Oak Street", "rue de la Paix 5"]
    assert pii.redacted("x a@b.cd y", pii.find_spans("x a@b.cd y")) == "x <email> y"
    rows = [(1, PII, "en", "s", 1), (2, None, "en", "s", 0), (2, "", None, None, 7)] * 2
    df = pii.find_personal_data(frame(spark, rows))
    assert df.count() == 6 and {r.base_sha256 for r in df.where("doc_id = 2").collect()} == {hashlib.sha256(b"").hexdigest()}
    red = pii.redact(frame(spark, rows, extra=False), length_col="n_chars").collect()
    assert all(r.text is None and r.n_chars == 0 or len(r.text) == r.n_chars for r in red) and not any("@ex-a" in (r.text or "") for r in red)


# 10. Line rules


def rules_truth(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def test_line_rules(spark):
    extra = [(900, "a b c\na b c\n\n \na b c", "en", "s", 0), (901, "x | y ## é\n\x0bq\x1fr", "en", "s", 0), (902, "\n\n", "en", "s", 0), (903, "a a a a", "en", "s", 0)]
    rows = documents() + extra
    got = line_crf.judge_lines(frame(spark, rows)).collect()
    truth = bag((r[0], *rules_truth(r[1])) for r in rows)
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == truth
    assert not any(r.kept and r.base_failed for r in got) and line_crf.judge_lines(spark.createDataFrame([], DOCS)).count() == 0
    lines = Counter((r.doc_id, len(r.content_lines)) for r in got)
    assert lines == Counter((r[0], (r[1] or "").count("\n") + 1) for r in rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 5, 9, 16])
    emit, trans = rng.normal(size=(16, 2)), rng.normal(size=(2, 2))
    got = line_crf.viterbi(emit, first, trans)
    for a, b in zip(first[:-1], first[1:], strict=True):
        score = lambda y, a=a: sum(emit[a + t, y[t]] for t in range(len(y))) + sum(trans[y[t], y[t + 1]] for t in range(len(y) - 1))
        best = max(score([int(c) for c in np.binary_repr(k, b - a)]) for k in range(2 ** (b - a)))
        assert score(got[a:b].tolist()) == pytest.approx(best)


def test_crf_separates_content():
    texts, labels = line_crf.example_lines(seed=50, texts=80)
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = line_crf.measure(off, np.frombuffer(b"".join(raw), np.uint8))
    w, tr = line_crf.train()
    assert (line_crf.viterbi(got["x"] @ w, got["first"], tr) == np.concatenate(labels)).mean() > 0.95


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("aB1 .é\n", max_size=20), max_size=6))
def test_vector_words(texts):
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    got = []
    for _, offsets, data in textvec.pieces(iter([batch]), "text", 8):
        start, end, first, _ = textvec.text_words(offsets, data)
        for a, b in zip(first[:-1], first[1:], strict=True):
            got.append([bytes(data[s:e]).decode() for s, e in zip(start[a:b], end[a:b], strict=True)])
    assert got == [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t) for t in texts]
