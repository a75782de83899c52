"""The text operators on Spark: brute force on the given tables, and rows that are empty, null, tied or repeated."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm import (bpe, fingerprints, kneser_ney, languages, main_text, mixing, near_duplicates, order_minhash, pii,
                          quality, risk_rules)
from fluxloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60 ", "changed ")
LONG = "Lorem ipsum dolor, sit amet. " * 20_000
MESSY = [
    (1, BASE, "en", "a", 5), (2, NEAR, "en", "a", 5), (3, BASE, "en", None, 5), (3, BASE, "en", None, 5),
    (4, None, "de", "b", None), (5, "", "de", "b", 0), (6, "  \n\t ", None, "b", 4), (7, LONG, "la", "c", len(LONG)),
    (None, "no id here, but words enough to count", "en", "c", 1), (8, "123 +1 (212) 555-0123 a.b@c.example", None, None, 2),
    (9, "short text", "fr", "ñ", 10), (9, "another text of the same id", "fr", "ñ", 10), (10, "", "de", "b", 0),
    (11, "\U0001f600 é́ x\x00y", "fr", "\U0001f600", 7),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
CLASHES = ("row", "score", "lang_pred", "node", "id", "key", "block", "size", "shards", "draw", "ids", "spans", "base",
           "n", "bands", "statistics", "held_out", "redacted", "pieces", "at")


@pytest.fixture(scope="module")
def messy(spark):
    rows = spark.createDataFrame(MESSY, SCHEMA)
    return rows.withColumns({name: F.lit(f"own {name}") for name in CLASHES})


@pytest.fixture(scope="module")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def by(rows, key="doc_id"):
    return {row[key]: row for row in rows}


# ---- op1

def plain_facts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_facts_of_messy_rows(messy):
    found = risk_rules.facts(messy).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(row[c] for c in columns) for row in found) == sorted(plain_facts(row[1]) for row in MESSY)


def test_cutoffs_are_exact_binomial_bounds(spark):
    """One rule, one stratum: the strictest cutoff whose exact tail is small enough, as plain sums find it."""
    n, risk = 400, risk_rules.Risk(total_risk=0.05, delta=0.05, rules=(
        risk_rules.Rule("symbols", "n_symbols", "word_chars", 1, (0.01, 0.05, 0.1, 0.2)),))
    # 30 texts have a share of 0.02, 8 of 0.07, 5 of 0.15; the others none.
    shares = [0.02] * 30 + [0.07] * 8 + [0.15] * 5 + [0.0] * (n - 43)
    rows = [(i, "x", 100, 1000, int(share * 1000), 0, 0, 0, 1) for i, share in enumerate(shares)]
    counted = spark.createDataFrame(rows, "key long, stratum string, n_words long, word_chars long, n_symbols long, "
                                          "n_repeat_words long, n_marks long, n_dup_lines long, n_lines long")
    labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(i, 0) for i in range(n, n + 50)], "doc_id long, quality int")
    found = risk_rules.cutoffs(counted, labels, risk).first()["cutoffs"][0]

    def tail(k):
        return sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))

    safe = [c for c in risk.rules[0].grid if tail(sum(s > c for s in shares)) <= 0.05]
    assert found == min(safe) and 0.01 not in safe
    few = risk_rules.cutoffs(counted.limit(20), labels, risk).first()["cutoffs"]
    assert few == [None]


def test_settings_keep_their_promise_in_every_family(spark):
    """Two rules, eight strata with a test of their own and six pooled ones: chosen are the strictest settings whose exact
    tail is small enough, and their true rates of false rejection, known from the draws, stay below the risk."""
    risk = risk_rules.Risk(total_risk=0.05, delta=0.05, rules=(
        risk_rules.Rule("symbols", "n_symbols", "word_chars", 1, (0.02, 0.04, 0.06, 0.08, 0.1)),
        risk_rules.Rule("shouting", "n_marks", "n_words", 1, (0.1, 0.2, 0.4))))
    draw, rows, top = np.random.default_rng(7), [], {}
    for at, n in enumerate([900, 700, 500, 400, 300, 250, 200, 150, 30, 25, 20, 15, 10, 5]):
        name = f"s{at}"
        top[name] = 0.04 + 0.008 * at  # ratios are even between 0 and this, and in a hundredth of all documents high
        low = draw.uniform(0, top[name], n)
        marks = np.where(draw.uniform(size=n) < 0.01, 0.5, 0.05)
        rows += [(len(rows) + i, name, 1000, 1_000_000, int(s * 1_000_000), 0, int(m * 1000), 0, 1)
                 for i, (s, m) in enumerate(zip(low, marks, strict=True))]
    counted = spark.createDataFrame(rows, "key long, stratum string, n_words long, word_chars long, n_symbols long, "
                                          "n_repeat_words long, n_marks long, n_dup_lines long, n_lines long")
    labels = spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int")
    found = risk_rules.cutoffs(counted, labels, risk).collect()
    assert sorted(row["stratum"] for row in found if not row["pooled"]) == sorted(f"s{i}" for i in range(8))
    assert [row["n"] for row in found if row["pooled"]] == [105]
    path = risk_rules.settings(risk.rules)
    assert path[2:] == [[0.06, 0.4], [0.08, 0.4], [0.1, 0.4]]
    for row in found:
        own = [r for r in rows if (r[1] in {f"s{i}" for i in range(8, 14)} if row["pooled"] else r[1] == row["stratum"])]
        n, best = len(own), None
        for symbols, marks in reversed(path):
            k = sum(r[4] / r[3] > symbols or r[6] / r[2] > marks for r in own)
            if sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.05 / 9:
                break
            best = [symbols, marks]
        assert row["cutoffs"] == (best or [None, None])
        if best and not row["pooled"]:
            assert 1 - min(1, best[0] / top[row["stratum"]]) * (1 if best[1] < 0.05 else 0.99) <= 0.05
    assert sum(row["cutoffs"][0] is not None for row in found) >= 4


def test_small_strata_take_the_setting_of_their_pool(spark):
    """A stratum with few labels and one without any are judged by the pool; one with enough by its own."""
    risk = risk_rules.Risk(total_risk=0.05, rules=(risk_rules.Rule("symbols", "n_symbols", "word_chars", 1, (0.0001, 0.1)),))
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{words} {'#' if i < 200 else ''}", "big") for i in range(400)]
    rows += [(i, words, f"small{i % 3}") for i in range(400, 700)]
    rows += [(700, f"{words} #", "big"), (701, f"{words} #", "small1"), (702, f"{words} #", "unlabelled"), (703, f"{words} #", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(700) if i < 400 or i % 5 < 2], "doc_id long, quality int")
    kept = by(risk_rules.judge(docs, labels, risk).filter("key >= 699").collect(), "key")
    assert [kept[i]["kept"] for i in (699, 700, 701, 702, 703)] == [True, True, False, False, False]
    assert kept[702]["rules"] == ["symbols"]


def test_rules_without_rows_or_labels(messy, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert risk_rules.judge(empty, labels).collect() == []
    found = risk_rules.judge(messy, labels).collect()
    assert len(found) == len(MESSY) and all(row["kept"] != row["base_failed"] for row in found)


# ---- op2

def test_pages_of_any_kind(spark):
    rows = [(1, "u", "<article><p>a&amp;b</p></article>"), (1, "u", "<article><p>a&amp;b</p></article>"), (2, None, None),
            (None, "v", ""), (3, "w", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("text", F.lit("x"))
    found = main_text.extract(pages).select("row.page_id", "row.text", F.col("text").alias("t")).collect()
    assert sorted(row["t"][:4] for row in found) == ["", "", "a&b", "a&b", "word"] and {row["text"] for row in found} == {"x"}
    assert main_text.extract(pages.limit(0)).collect() == []


def test_pages_of_the_table(spark, sf):
    import html

    rows = by(spark.read.parquet(f"{sf}/pages.parquet").collect(), "page_id")
    for row in QUERIES["op2_html"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", rows[row["page_id"]]["html"], re.DOTALL)[1]
        assert row["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert row["n_chars"] == len(row["text"])


# ---- op3

def test_model_equals_plain_counts(spark):
    """All probabilities by dictionaries; those of one context sum to one."""
    texts = ["a b a b c", "A b", "c c c a", None, "b a d", "a b a", "e", "c a b e a b", "d d e"] * 3 + ["f g a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "a zzz b"])], "doc_id long, text string")
    model = kneser_ney.train(docs.filter(f"doc_id < {len(texts)}"), range_bytes=8)
    assert model.ranges > 3
    found = by(kneser_ney.score(docs, model).select("row.doc_id", "n_tokens", "n_known", "base_score", "score").collect())
    pairs, tokens = Counter(), Counter()
    for text in texts:
        row = ["<s>", *(text or "").lower().split(), "</s>"]
        pairs.update(zip(row, row[1:]))  # noqa: B905
        tokens.update(row[1:])
    n, v = sum(tokens.values()), len(tokens)
    assert (model.n_tokens, model.n_words, model.n_pairs) == (n, v, len(pairs))
    levels = lambda counts: [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    before = Counter(w for _, w in pairs)
    d2, d1 = kneser_ney.discounts(levels(pairs.values())), kneser_ney.discounts(levels(before.values()))

    def p(w, ctx):
        rest = sum(d1[min(c, 3)] for c in before.values()) / len(pairs)
        own = max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) + rest / (v + 1)
        follow = {b: c for (a, b), c in pairs.items() if a == ctx}
        total = sum(follow.values())
        if not total:
            return own
        back = sum(d2[min(c, 3)] for c in follow.values()) / total
        return max(follow.get(w, 0) - d2[min(follow.get(w, 0), 3)], 0) / total + back * own

    for ctx in ("a", "<s>", "zzz"):
        assert sum(p(w, ctx) for w in [*tokens, "zzz"]) == pytest.approx(1)
    for i, text in enumerate([*texts, "a zzz b"]):
        row = ["<s>", *(text or "").lower().split(), "</s>"]
        assert found[i]["n_tokens"] == len(row) - 1 and found[i]["n_known"] == sum(w in tokens for w in row[1:])
        assert found[i]["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in row[1:]))
        assert found[i]["score"] == pytest.approx(sum(math.log10(p(w, c)) for c, w in zip(row, row[1:])))  # noqa: B905


def test_model_of_messy_rows(messy, empty):
    model = kneser_ney.train(messy)
    found = kneser_ney.score(messy, model).select("n_tokens", "score", "row.score").collect()
    assert len(found) == len(MESSY) and all(math.isfinite(row[1]) and row[1] <= 0 for row in found)
    nothing = kneser_ney.train(empty)
    assert nothing.n_tokens == 0 and kneser_ney.score(empty, nothing).collect() == []
    assert {row["score"] for row in kneser_ney.score(messy.drop("score"), nothing).collect()} == {0.0}


def test_held_out_texts_score_better_than_base(spark, sf):
    rows = [row for row in QUERIES["op3_kneser_ney"](spark, sf).collect() if row["held_out"]]
    assert sum(row["score"] for row in rows) > sum(row["base_score"] for row in rows)


# ---- op4

def test_spans_of_messy_rows(messy, empty):
    found = pii.detect(messy).select("row.doc_id", "row.spans", F.col("spans").alias("s"), "redacted").collect()
    assert len(found) == len(MESSY) and {row["spans"] for row in found} == {"own spans"}
    row = by(found)[8]
    assert [s["kind"] for s in row["s"]] == ["email", "phone"] and row["redacted"] == "123 [phone] [email]"
    assert by(found)[4]["redacted"] is None and pii.detect(empty).collect() == []


def test_digest_of_the_table(spark, sf, documents):
    found = by(QUERIES["op4_pii"](spark, sf).collect())
    for doc in documents:
        spans = pii.patterns(doc["text"] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert found[doc["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert found[doc["doc_id"]]["n_phone"] == sum(k == "phone" for k, _, _ in spans)
        assert set(filter(None, text.split(","))) <= set(found[doc["doc_id"]]["spans"].split(","))


# ---- op5

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = by(QUERIES["op5_quality_classifier"](spark, sf).filter("held_out").collect())
    labels = [row for row in spark.read.parquet(f"{sf}/labels.parquet").collect() if row["doc_id"] in found]
    assert np.mean([found[row["doc_id"]]["predicted"] == row["quality"] for row in labels]) > 0.95
    repeat = by(QUERIES["op5_quality_classifier"](spark, sf).collect())
    assert all(repeat[k]["score"] == row["score"] for k, row in found.items())


def test_quality_of_messy_rows(messy, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 0), (99, 1), (7, None)], "doc_id long, quality int")
    found = quality.classify(messy, labels).select("row.score", F.col("score").alias("s")).collect()
    assert len(found) == len(MESSY) and all(0 <= row["s"] <= 1 for row in found) and found[0]["score"] == "own score"
    none = quality.classify(messy, labels.limit(0)).collect()
    assert {row["score"] for row in none} == {0.5} and quality.classify(empty, labels).collect() == []


# ---- op6

def tiktoken_ids(vocab):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={}).encode_ordinary


def test_ids_equal_the_library(messy, empty):
    vocab = bpe.public_vocabulary()
    plain = tiktoken_ids(vocab)
    for size in (64, 1 << 20):
        coded = bpe.encode(messy, vocab, block_bytes=size)
        found = bpe.decode(coded, vocab).select("row.doc_id", "row.ids", F.col("ids").alias("i"), "bytes").collect()
        key = lambda row: (row[0] is None, row[0] or 0, row[1])
        got = sorted(((row["doc_id"], bytes(row["bytes"]).decode(), row["i"]) for row in found), key=key)
        assert got == sorted(((row[0], row[1] or "", plain(row[1] or "")) for row in MESSY), key=key)
    assert bpe.decode(bpe.encode(empty, vocab), vocab).collect() == []


def test_digests_of_ids(spark, sf, documents):
    plain = tiktoken_ids(bpe.public_vocabulary())
    found = by(QUERIES["op6_byte_bpe"](spark, sf).collect())
    for doc in documents:
        ids = plain(doc["text"] or "")
        row = found[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


# ---- op7

def plain_classes(rows, sketch=order_minhash.Sketch()):
    """All pairs of different texts, linked if alike; (id, text) -> least id of the component."""
    texts = sorted({text for _, text in rows if text is not None})
    grams = [order_minhash.kmers([t], sketch.k)[0] for t in texts]
    roots = list(range(len(texts)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i]) and len(grams[j]) and order_minhash.similar(grams[i], grams[j], sketch.threshold)[0]:
                roots[root(i)] = root(j)
    least = {}
    of = {t: root(i) for i, t in enumerate(texts)}
    for doc, text in rows:
        if text is not None and doc is not None:
            least[of[text]] = min(least.get(of[text], doc), doc)
    return {(doc, text): doc if text is None else least.get(of[text]) for doc, text in rows}


def test_classes_of_messy_rows(messy, empty):
    found = Counter((row["id"], row["class_id"]) for row in near_duplicates.classify(messy).collect())
    expected = plain_classes([(row[0], row[1]) for row in MESSY])
    assert found == Counter((row[0], expected[row[0], row[1]]) for row in MESSY)
    assert near_duplicates.classify(empty).collect() == []
    kept = near_duplicates.representatives(messy)
    assert kept.columns == messy.columns
    ids = sorted((row["doc_id"] or 0, row["text"] or "") for row in kept.collect())
    assert [i for i, _ in ids] == [0, 1, 4, 5, 6, 7, 8, 9, 9, 11] and near_duplicates.representatives(empty).collect() == []


def test_components_of_links(spark):
    """Chains, stars, whole clouds, loops and repeated links against a union by hand."""
    draw = np.random.default_rng(1)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)] + [("s0", f"s{i}") for i in range(1, 30)]
    links += [(f"k{i}", f"k{j}") for i in range(15) for j in range(i)] + [("x", "x"), ("k3", "k1"), ("k3", "k1")]
    links += [(f"r{a}", f"r{b}") for a, b in draw.integers(0, 200, (120, 2))]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for node in sorted(near):
        todo = [node]
        while todo:
            at = todo.pop()
            if at not in expected:
                expected[at] = node
                todo += near[at]
    expected.pop("x")
    found = near_duplicates.connected(spark.createDataFrame(links, "a string, b string")).collect()
    assert {row["node"]: row["root"] for row in found} == expected and len(found) == len(expected)


def test_classes_of_a_family_of_near_copies(spark):
    """Copies of one text with many changes: chains of links that no hub has, and a passage that strangers share."""
    draw = np.random.default_rng(2)
    base = [f"b{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(150):
        words = list(base)
        for at in draw.choice(60, draw.integers(0, 4), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    for i in range(60):
        own = " ".join(f"o{i}_{j}" for j in range(draw.integers(5, 40)))
        rows.append((1000 + i, f"{own} {passage}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_classes(rows)
    found = {row["id"]: row["class_id"] for row in near_duplicates.classify(docs).collect()}
    assert len(set(expected.values())) > 3
    assert found == {doc: expected[doc, text] for doc, text in rows}


def test_classes_of_a_cloud_below_the_threshold(spark):
    """Copies most pairs of which lie just below the threshold: hubs link a part, the rest must be found in full."""
    draw = np.random.default_rng(5)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in draw.choice(130, draw.integers(1, 7), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_classes(rows)
    found = {row["id"]: row["class_id"] for row in near_duplicates.classify(docs).collect()}
    assert len(set(expected.values())) > 3 and found == {doc: expected[doc, text] for doc, text in rows}


def test_classes_of_short_texts(spark):
    """One word changed, dropped or added in texts of 8 to 20 words: bands of so few minima miss many of these pairs."""
    rows = []
    for n in range(8, 21):
        for family in range(6):
            words = [f"w{n}_{family}_{j}" for j in range(n)]
            edits = (words + ["more"], words[:-1] + ["other"], words[1:], ["first"] + words[1:], words[:4] + ["x"] + words[5:])
            for text in (words, edits[family % 5], edits[(family + 1) % 5]):
                rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_classes(rows)
    found = {row["id"]: row["class_id"] for row in near_duplicates.classify(docs).collect()}
    assert 0 < len(set(expected.values())) < len(rows)
    assert found == {doc: expected[doc, text] for doc, text in rows}


def test_classes_of_the_table(spark, sf, documents):
    expected = plain_classes([(row["doc_id"], row["text"]) for row in documents])
    found = {row["doc_id"]: row["class_id"] for row in QUERIES["op7_near_duplicates"](spark, sf).collect()}
    assert found == {doc: name for (doc, _), name in expected.items()}


# ---- op8

def test_mix_of_messy_rows(messy, empty):
    mix = mixing.Mix(block_words=16, shard_words=2000)
    rows = mixing.assign(messy, mix).collect()
    assert len(rows) == len(MESSY)
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in rows:
        size = len(WORD.findall(row["row"]["text"] or ""))
        assert row["size"] == size and len(row["shards"]) <= 2
        sizes[row["row"]["source"]] += size
        taken[row["row"]["source"]] += size * len(row["shards"])
    assert {row["row"]["source"]: row["source_size"] for row in rows} == dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mixing.targets([sizes[s] for s in order], (3, 1, 2), 1.5, 2.0), strict=True))
    assert {row["row"]["source"]: row["target"] for row in rows} == goals
    out = mixing.mix(messy, mix).select("row.doc_id", "row.size", "shard", "place").collect()
    assert len(out) == sum(len(row["shards"]) for row in rows) and {row["size"] for row in out} <= {"own size"}
    again = mixing.mix(messy.repartition(7), mix).select("row.doc_id", "row.size", "shard", "place").collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.assign(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_mix_comes_near_its_targets_in_every_shard(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 300)), "abc"[i % 3] if i % 5 else "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(block_words=500, shard_words=80_000)
    found = mixing.assign(docs, mix).select("row.doc_id", "row.source", "size", "target", "shards").collect()
    taken, shards = Counter(), defaultdict(Counter)
    goals = {row["source"]: row["target"] for row in found}
    for row in found:
        taken[row["source"]] += row["size"] * len(row["shards"])
        for shard in row["shards"]:
            shards[shard][row["source"]] += row["size"]
    for source, goal in goals.items():
        assert taken[source] == pytest.approx(goal, rel=0.01)
    assert len(shards) > 4
    totals = [sum(own.values()) for own in shards.values()]
    assert max(totals) < 1.5 * min(totals)


def test_mix_fills_behind_a_document_longer_than_the_target(spark):
    first = min(range(10_000, 11_000), key=lambda i: hashlib.md5(f"8|{i}".encode()).hexdigest())
    rows = [(i, " ".join(["w"] * (20 + i * 7 % 300)), "abc"[i % 3]) for i in range(1500)]
    rows.append((first, "w " * 400_000, "b"))  # weight 1 of 6: the target is far below this document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(share=0.4, block_words=500, shard_words=40_000)
    found = mixing.assign(docs, mix).select("row.doc_id", "row.source", "size", "target", "shards").collect()
    taken = Counter()
    for row in found:
        taken[row["source"]] += row["size"] * len(row["shards"])
    for row in found:  # one more time, or one time less, would not be nearer
        gap = row["target"] - taken[row["source"]]
        assert len(row["shards"]) <= 2 and abs(gap) <= min(r["size"] for r in found if r["source"] == row["source"])
        assert len(row["shards"]) == 2 or abs(gap - row["size"]) >= abs(gap)
    of_b = [row for row in found if row["source"] == "b"]
    assert not next(row for row in of_b if row["doc_id"] == first)["shards"]
    assert taken["b"] == pytest.approx(of_b[0]["target"], rel=0.001) or all(
        len(row["shards"]) == 2 for row in of_b if row["doc_id"] != first)
    shards = Counter(shard for row in of_b for shard in row["shards"])
    assert len(shards) > 2 and max(shards.values()) < 3 * min(shards.values())


# ---- op9

def test_fingerprints_of_messy_rows(messy, empty, spark):
    rows = [(doc, text or "") for doc, text, *_ in MESSY]
    found = fingerprints.compare(messy).collect()
    assert len(found) == len(rows) and fingerprints.compare(empty).collect() == []
    by_key = defaultdict(list)
    for row in found:
        by_key[row["key"]].append(row)
    assert by_key[1][0]["fingerprint"] == by_key[3][0]["fingerprint"] == by_key[3][1]["fingerprint"]
    assert by_key[5][0]["fingerprint"] == "" and by_key[5][0]["near_edited"] == 1.0
    # Unique neighbours: 2 follows 3, 1 follows 2, null (last) follows 1, 11 (first) follows null.
    text = dict(rows)
    for key, nxt in ((2, 1), (1, None), (None, 11), (7, 6)):
        n = len(text[key])
        edited = text[key][: n - n // 3] + text[nxt][: n // 3]
        assert by_key[key][0]["n_chars"] == n
        assert by_key[key][0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert by_key[2][0]["near_next"] > 0.5 > by_key[7][0]["near_next"]
    one = fingerprints.compare(messy.filter("doc_id = 9 and text = 'short text'")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprints_across_blocks(spark, sf, documents, monkeypatch):
    """The same results however rows are blocked; edited texts nearer than strangers."""
    whole = by(QUERIES["op9_fingerprints"](spark, sf).collect())
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    cut = by(QUERIES["op9_fingerprints"](spark, sf).collect())
    assert whole == cut
    order = sorted(documents, key=lambda row: -row["doc_id"])
    for row, nxt in zip(order, order[1:] + order[:1], strict=True):
        text, n = row["text"] or "", len(row["text"] or "")
        edited = text[: n - n // 3] + (nxt["text"] or "")[: n // 3]
        assert whole[row["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    long = [whole[row["doc_id"]] for row in order if len(row["text"] or "") > 600]
    assert np.mean([row["near_edited"] > row["near_next"] for row in long]) > 0.95


def plain_fingerprint(spark, text, shape):
    """Bins and tuples by dictionaries, with Spark's hash called on literals."""
    words = WORD.findall(text)
    windows = [words[i : i + shape.k] for i in range(max(1, len(words) - shape.k + 1))] if words else []
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "i int, w array<string>")
    hashed = [row["h"] for row in rows.select("i", F.xxhash64(*[F.get("w", F.lit(j)) for j in range(shape.k)]).alias("h"))
              .orderBy("i").collect()]
    seen, numbered = Counter(), []
    for h in hashed:
        seen[h] += 1
        numbered.append((h, seen[h]))
    rows = spark.createDataFrame([(i, h, n) for i, (h, n) in enumerate(numbered)], "i int, h long, n long")
    best = {}
    for row in rows.select("i", F.xxhash64("h", "n").alias("h")).collect():
        slot = ((row["h"] % (1 << 64)) >> 7) % (shape.tuples * shape.width)
        best[slot] = min(best.get(slot, (1 << 63, 0)), (row["h"], row["i"]))
    tuples = defaultdict(list)
    for slot, (h, i) in best.items():
        tuples[slot // shape.width].append((i, h))
    rows = spark.createDataFrame([(t, [h for _, h in sorted(own)]) for t, own in tuples.items()], "t int, h array<long>")
    signs = {row["t"]: row["s"] % (1 << 64) for row in rows.select("t", F.xxhash64("h").alias("s")).collect()}
    return ",".join(f"{t:x}:{signs[t] & 0xFFFFFFFF:08x}" for t in sorted(signs))


@pytest.mark.parametrize("text", ["a b c d e f g h a b c d e f g h a b c d e", BASE, "one two", "x " * 40])
def test_fingerprint_equals_its_definition(spark, text):
    shape = fingerprints.Shape(k=3, tuples=8, width=2)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert fingerprints.compare(docs, shape=shape).first()["fingerprint"] == plain_fingerprint(spark, text, shape)


# ---- op10

def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = by(QUERIES["op10_languages"](spark, sf).filter("held_out").collect())
    rows = [row for row in spark.read.parquet(f"{sf}/documents.parquet").collect() if row["doc_id"] in found]
    assert np.mean([found[row["doc_id"]]["lang_pred"] == row["lang"] for row in rows]) > 0.97


def test_languages_of_messy_rows(messy, empty):
    profiles = languages.learn(messy)
    assert profiles.names == ["en", "fr", "la"]  # texts in de have no letter
    found = languages.identify(messy, profiles).select("row.doc_id", "row.text", "row.score", "lang_pred", F.col("score").alias("s")).collect()
    assert len(found) == len(MESSY) and {row["score"] for row in found} == {"own score"}
    for row in found:
        assert (row["lang_pred"] == "und") == (not any(c.isalpha() for c in row["text"] or ""))
        assert 0 <= row["s"] <= 1
    assert languages.learn(empty).names == [] and languages.identify(empty, profiles).collect() == []
    assert {row["lang_pred"] for row in languages.identify(messy, languages.learn(empty)).collect()} == {"und"}


# ---- pipeline

def test_stages_on_messy_rows(messy, empty, sf):
    for docs in (messy, empty):
        spark, current = docs.sparkSession, docs
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, current, sf)
            if at < len(corpus_pipeline.STAGES) - 1:
                assert found.columns == docs.columns
            stage(spark, docs, sf).count()  # every stage by itself
            current = found
        assert (current.count() > 0) == (docs is messy)


def plain_bars(rows, names, scores):
    """The bar of a language and a text: half of the least 1 % of the scores of texts of its length class or a shorter one."""
    held = {}
    for row, name, score in zip(rows, names, scores, strict=True):
        if name != "und" and name == row["lang"]:
            held.setdefault((name, int(math.log2(len(row["text"]) + 1))), []).append(score)
    low = {key: sorted(own)[max(0, math.ceil(0.01 * len(own)) - 1)] for key, own in held.items()}
    return lambda name, text: max([x / 2 for (of, size), x in low.items() if of == name and size <= math.log2(len(text) + 1)],
                                  default=0.0)


def test_unlearned_languages_are_not_known(spark, sf, documents):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    planted = [" ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n)) for n in (100, 200, 400, 1000) * 10]
    planted += ["wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem " * 4,
                "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki " * 4,
                "", "12 34", None]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = spark.createDataFrame([(10**6 + i, text) for i, text in enumerate(planted)], "doc_id bigint, text string")
    both = docs.unionByName(foreign, allowMissingColumns=True)
    found = languages.known(both, languages.learn(both)).select("row.*", "lang_pred", "score", "known").collect()
    assert len(found) == len(documents) + len(planted)
    assert not [r for r in found if r["doc_id"] >= 10**6 and r["known"]]
    assert sum(r["known"] for r in found) >= len(documents) - 2
    rows = [r for r in found if r["text"] is not None]
    bars = plain_bars(rows, [r["lang_pred"] for r in rows], [r["score"] for r in rows])
    assert all(r["known"] == (r["lang_pred"] != "und" and r["score"] >= bars(r["lang_pred"], r["text"])) for r in rows)


def test_known_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string, row string, known int")
    assert languages.known(empty, languages.learn(empty)).count() == 0
    rows = spark.createDataFrame([("und", "abc", "x"), (None, "abc", "y"), ("en", "the", None)], "lang string, text string, bar string")
    found = languages.known(rows, languages.learn(rows)).collect()
    assert len(found) == 3 and all(r["known"] for r in found if r["lang_pred"] != "und")


def test_pipeline_equals_its_definition(spark, sf, documents):
    """Every stage against plain code: only kept languages, least of each class, redacted, taken by the mixture, encoded."""
    found = corpus_pipeline.run(spark, sf).collect()
    learned = languages.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    names, scores = learned.predict([row["text"] for row in documents])
    bars = plain_bars(documents, names, scores)
    kept = [row for row, name, score in zip(documents, names, scores, strict=True)
            if name != "und" and score >= bars(name, row["text"])]
    assert len(kept) >= len(documents) - 2
    classes = plain_classes([(row["doc_id"], row["text"]) for row in kept])
    kept = [row for row in kept if classes[row["doc_id"], row["text"]] == row["doc_id"]]
    model = pii.train()
    texts = [pii.redact(row["text"], spans) for row, (_, spans) in zip(kept, pii.find([r["text"] for r in kept], model), strict=True)]
    con = duckdb.connect()
    table = {"doc_id": [r["doc_id"] for r in kept], "text": texts, "source": [r["source"] for r in kept]}
    import pyarrow as pa

    con.register("documents", pa.table(table))
    times = {row[0]: row[4] // row[1] if row[1] else 0 for row in con.execute(
        f"select doc_id, size, source_size, target, taken from ({ORACLES['op8_mixing']})").fetchall()}
    plain = tiktoken_ids(bpe.public_vocabulary())
    expected = Counter()
    for row, text in zip(kept, texts, strict=True):
        expected[row["doc_id"], row["lang"], row["source"], len(text), text, tuple(plain(text))] += times[row["doc_id"]]
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_chars"], r["text"], tuple(r["ids"])) for r in found)
    assert got == +expected


def test_queries_are_registered_once_each():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
