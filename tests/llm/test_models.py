"""Quality rules, classifier, language id, fingerprints, url filters."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import classifier, langid, quality, syncmers, urls

D = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


def odd(spark):
    texts = [None, "", " \n\t ", "a", "word " * 200, "é" * 300, "12 34 !!", "\x1c\x85 x\xa0y"]
    return spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)


def counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_by_brute_force(spark, docs):
    some = docs.unionByName(odd(spark).withColumn("doc_id", F.col("doc_id") + 100000))
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in quality.judge(some).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_rules_keep_clean_and_drop_junk(docs, labels):
    both = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {r.quality: r.k for r in both.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_jensen_shannon_bounds():
    p = np.array([[1.0, 0, 0], [0.5, 0.5, 0], [0, 0, 0]])
    d = quality.jensen_shannon(p, np.array([[1.0, 0, 0], [0, 0, 1]]))
    assert d[0, 0] == 0 and abs(d[0, 1] - 1) < 1e-12 and 0 < d[1, 0] < 1 and d[2, 0] == 1


def test_common_words_are_exact_counts(spark, docs):
    flat = spark.createDataFrame([(10**6 + k, " ".join(f"u{(k * 37 + j) % 3000}" for j in range(90)), "zz", None, 0) for k in range(400)], DOCS)
    some = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(flat)
    want = {}
    for r in some.where("lang IS NOT NULL").collect():
        want.setdefault(r.lang, Counter()).update((r.text or "").encode().split())
    rules = quality.QualityRules()
    got = {r[0]: r[2] for r in quality.language_references(some.repartition(7), rules)}
    assert set(got) == set(want)
    for lang, words in want.items():
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]
        assert got[lang] == {w.decode(): n / words.total() for w, n in top}


def test_rules_without_languages(spark):
    rows = quality.judge(odd(spark)).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [False] * 8 and rows[4].char_distance is None
    assert quality.judge(odd(spark).limit(0)).count() == 0
    assert quality.keep_by_rules(odd(spark).withColumn("kept", F.lit(1))).count() == 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels)
    rows = classifier.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_interactions_by_all_pairs():
    rng = np.random.default_rng(1)
    m = classifier.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)), np.zeros(9), np.ones(9))
    x = rng.normal(size=(4, 9))
    want = [0.3 + r @ m.w + sum(m.v[i] @ m.v[j] * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert np.allclose(m.margin(x), want)


def test_classifier_without_labels_or_texts(spark, labels):
    model = classifier.train(odd(spark), labels.limit(0))
    rows = classifier.score_documents(odd(spark), model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert classifier.keep_good(odd(spark).withColumn("score", F.lit("x")), model).columns[-1] == "score"
    assert classifier.score_documents(odd(spark).limit(0), model).count() == 0


def test_languages_on_held_out_rows(docs):
    rows = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_presence_kernel_by_sets():
    texts = ["the cat", "The hat sat", "zzz", "élan"]
    shape = langid.Shape()
    x = np.array([langid.presence(t, shape.grams) for t in texts]).astype(np.float32)
    grams = [{t.encode().lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)} for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    assert np.allclose(langid.kernel(x, x), want, atol=0.06)


def test_language_of_odd_texts(spark, docs):
    rows = langid.predict(odd(spark), langid.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False, False, True, False]
    nothing = langid.train(odd(spark))
    assert {r.lang_pred for r in langid.predict(odd(spark), nothing).collect()} == {"und"}


def test_fingerprints_against_pairs(spark, docs):
    rows = {r.doc_id: r for r in syncmers.fingerprint_pairs(docs.orderBy(F.rand(1)), 13).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    ids = sorted(texts)
    same = {}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        f = syncmers.fingerprint(t.encode())
        assert r.fingerprint == syncmers.written_out(f) and r.edited_fingerprint == syncmers.written_out(syncmers.fingerprint(edited.encode()))
        assert abs(r.near_next - syncmers.likeness(f, syncmers.fingerprint(nxt.encode()))) < 1e-12 and 0 <= r.near_edited <= 1
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert np.median([r.near_edited for r in rows.values()]) > 0.6 and np.median([r.near_next for r in rows.values()]) < 0.05


def test_anchors_by_definition():
    raw = b"the quick brown fox jumps over the lazy dog and back again " * 3
    inner, _ = syncmers._hashes(np.frombuffer(raw, dtype=np.uint8), syncmers.K)
    w = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(raw) - syncmers.K + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]
    h, at = syncmers.anchors(raw)
    assert at.tolist() == want and set(syncmers.anchors(b"zz" + raw)[0]) >= set(h)


def test_fingerprints_of_odd_texts(spark):
    some = odd(spark)
    rows = syncmers.fingerprint_pairs(some.unionByName(some.where("doc_id = 3")).unionByName(some.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 1
    one = syncmers.fingerprint_pairs(some.where("doc_id = 4")).first()
    assert one.near_next == 1.0
    assert syncmers.fingerprint_pairs(some.limit(0)).count() == 0


def test_likeness_counts_every_place_of_repeated_anchors():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(7)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (60, 3), (90, 12), (130, 400)):
        a, b = (rng.integers(0, kinds, int(rng.integers(n // 2, n + 1))).tolist() for _ in range(2))
        assert syncmers._chain(a, b) == plain(a, b) and syncmers._chain(a, a[:5] + b + a[-5:]) == plain(a, a[:5] + b + a[-5:])
    line = "the same line of a page comes again and again, word for word\n"
    f, g = syncmers.fingerprint((line * 60).encode()), syncmers.fingerprint((line * 45 + "and now for something else").encode())
    assert abs(syncmers.likeness(f, g) - plain(f[1].tolist(), g[1].tolist()) / max(len(f[1]), len(g[1]))) < 1e-12 and syncmers.likeness(f, g) > 0.7


def test_long_text_of_few_anchors_keeps_some():
    for k in range(40):  # several hundred anchors of few hashes
        raw = (f"line {k} of the page " * 400).encode()
        h, _ = syncmers.anchors(raw)
        assert len(h) > 2 * syncmers.ANCHORS
        level, kept, _ = syncmers.fingerprint(raw)
        assert level == 0 and np.array_equal(kept, h)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def test_url_rules_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    extra = [(-1, None), (-2, "no scheme"), (-3, "x://A.COM/en/1?x://b"), (-4, "http://a.net"), (-5, "http://xnet/de/1"), (-6, "http://a.example.com/en/77#x"), (-7, "http://a.example.net/de/8"), (-8, "://net/de/")]
    every = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string"))
    known = {r.page_id: r.url for r in every.collect()}
    mined = urls.mine_rules(every.join(labels, F.col("page_id") == F.col("doc_id")).select(urls.tokens(*urls.host_and_path(F.col("url"))).alias("items"), (F.col("quality") == 0).alias("bad")))
    needs = [set(r["items"]) for r in mined.collect()]
    rows = urls.judge_urls(every.withColumn("rule", F.lit("x")), labels).collect()
    assert len(rows) == len(known)
    for r in rows:
        host, path = split_url(known[r.page_id])
        fits = [(v, x) for v, x in urls.RULES if ("." + host).endswith("." + x.split("/", 1)[0]) and path.startswith("/" + x.split("/", 1)[1])]
        best = max(fits, key=lambda v: len(v[1]), default=(None, None))
        have = {"h:" + x for x in host.split(".") if x} | {"p:" + x for x in re.sub("[0-9]+", "0", path).split("/") if x}
        method = "block" if any(n <= have for n in needs) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[0] or method)
    assert urls.judge_urls(every.limit(0), labels).count() == 0 and urls.judge_urls(every, labels.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0


def test_mined_rules_find_a_planted_host(spark):
    rows = [([f"h:{h}", "h:com", f"p:{k % 3}"], h == "spam") for k in range(300) for h in ("spam", "good")]
    got = urls.mine_rules(spark.createDataFrame(rows, "items array<string>, bad boolean")).collect()
    assert [(r["items"], r.rare, r.confidence) for r in got] == [(["h:spam"], "h:spam", 1.0)]


def test_references_do_not_depend_on_layout(spark, docs):
    rules = quality.QualityRules()
    one, many = (quality.language_references(docs.repartition(n), rules) for n in (1, 64))
    assert one == many
    shares = {}
    for r in docs.where("lang IS NOT NULL").collect():
        raw = (r.text or "").encode()
        if len(raw) >= rules.min_chars:
            seen = quality.class_counts(raw)
            shares.setdefault(r.lang, []).append([round(v) for v in (quality.STEPS * seen / seen.sum()).tolist()])
    for lang, got, _ in one:
        middle = np.sort(np.array(shares[lang]), axis=0)[(len(shares[lang]) - 1) // 2]
        assert np.allclose(got, middle / middle.sum())


def test_rules_verdict_by_plain_formula(spark, docs):
    """kept by a plain Jensen-Shannon distance on histograms counted character by character and word by word."""
    rules = quality.QualityRules()
    refs = quality.language_references(docs, rules)
    kind = {c: k for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:?'\"-()", quality.SYMBOLS)) for c in chars}

    def apart(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        return (sum(x[k] * np.log2(x[k] / m[k]) for x in (p, q) for k in x if x[k] > 0) / 2) ** 0.5

    common = {w for r in refs for w in r[2]}
    for r in quality.judge(docs, rules, refs).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = (r.text or "").encode().split()
        chars = Counter(kind.get(c, 7 if ord(c) < 128 else 8) for c in r.text or "")
        seen = Counter(w.decode() if w.decode() in common else None for w in words)
        kept = not r.base_failed
        if chars.total() >= rules.min_chars:
            kept &= min(apart({k: n / chars.total() for k, n in chars.items()}, dict(enumerate(ref[1]))) for ref in refs) <= rules.char_distance
        if len(words) >= rules.min_words:
            kept &= min(apart({k: n / len(words) for k, n in seen.items()}, {**ref[2], None: 1 - sum(ref[2].values())}) for ref in refs) <= rules.word_distance
        assert r.kept == kept


def test_number_characters_are_no_letters_and_null_ids_are_not_held_out(spark, docs, labels):
    rows = spark.createDataFrame([(None, "½ ² Ⅷ ①", None, None, 0), (None, "the house", "en", None, 0), (2, "x", "en", None, 0), (2, "x", "en", None, 0)], DOCS)
    got = langid.predict(rows, langid.train(docs)).collect()
    assert [r.lang_pred == "und" for r in got if r.doc_id is None] == [True, False] and len(got) == 4
    assert not any(r.held_out for r in got if r.doc_id is None)
    scored = classifier.score_documents(rows, classifier.train(docs, labels)).collect()
    assert len(scored) == 4 and all(isinstance(r.held_out, bool) for r in scored)


def test_every_language_is_learnt(spark):
    rows = [(k, f"{chr(0x4E00 + 7 * (k % 70))}{chr(0x3000 + 64 + k % 70)} " * 30, f"l{k % 70:02}", None, 0) for k in range(1400)]
    some = spark.createDataFrame(rows, DOCS)
    model = langid.train(some)
    assert len(model.langs) == 70 and len(model.landmarks) >= 140
    got = langid.predict(some, model).join(some.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_written_fingerprints_give_the_likeness(spark, docs):
    rows = {r.doc_id: r for r in syncmers.fingerprint_pairs(docs).collect()}
    ids = sorted(rows)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b, c = (syncmers.parsed(x) for x in (rows[i].fingerprint, rows[i].edited_fingerprint, rows[j].fingerprint))
        assert rows[i].near_edited == syncmers.likeness(a, b) and rows[i].near_next == syncmers.likeness(a, c)
    text = " ".join(f"word{k * k}" for k in range(3000)).encode()
    twice = syncmers.fingerprint(text), syncmers.fingerprint(text + b" " + text)
    assert syncmers.likeness(*twice) == syncmers.likeness(*(syncmers.parsed(syncmers.written_out(f)) for f in twice))
    assert len(syncmers.fingerprint(text, None)[1]) == len(syncmers.anchors(text)[1])
