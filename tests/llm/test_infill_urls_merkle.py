"""Fill-in-middle, URL filters and the Merkle manifest against plain versions; messy, empty and clashing rows."""

import hashlib
import re
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm import infill, merkle, url_filter
from fluxloom.llm.infill import Infill

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
LONG = "Lorem ipsum dolor, sit amet. " * 40_000
MESSY = [(1, "one two three", "en", "a", 5), (2, None, None, None, None), (3, "", "de", "", 0), (4, " \n\t ", "de", "b", 4),
         (5, LONG, "la", "b", len(LONG)), (None, "no id", "en", "b", 1), (None, "No id", "en", None, 1), (6, "has <S> in it", "en", "b", 3),
         (7, "é \U0001f600 x\x00y ñ ", "fr", "\U0001f600", 7), (7, "é \U0001f600 x\x00y ñ ", "fr", "\U0001f600", 7),
         (7, "other text of the same id", "fr", "ｆ", 7), (8, "A" * 30, "en", "퟿", 30)]
CLASHES = ("row", "n", "form", "output", "restored", "draws", "host", "path", "rule", "verdict", "tree", "digest", "claim", "at",
           "size", "block", "nodes", "turn", "range", "key", "leaf", "root", "proof", "prefix_chars", "each")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text):
    text = text or ""
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_of_messy_rows(spark):
    rows = MESSY + [(i, text, None, None, None) for i in range(100, 160) for _, text, *_ in MESSY[:2] + MESSY[8:9]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("own") for name in CLASHES})
    found = infill.restore(infill.rearrange(docs), out="again").collect()
    got = sorted((str(r["row"]["doc_id"]), r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["again"])
                 for r in found)
    wanted = []
    for doc_id, text, *_ in rows:
        n, form, prefix, middle, output = plain_infill(doc_id, text)
        wanted.append((str(doc_id), n, form, prefix or 0, middle or 0, output, text or ""))
    assert got == sorted(wanted) and {r["row"]["form"] for r in found} == {"own"}
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert infill.restore(infill.rearrange(docs.limit(0))).collect() == []


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab é\n<>PSM", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_rotations_are_undone(text, a, b, form):
    data = text.encode()
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    how = Infill()
    if any(mark in data for mark in how.marks):
        return
    output = bytes(infill.rearranged(data, a, b, form, how))
    p, m, s = data[:a], data[a:b], data[b:]
    assert output == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
    assert bytes(infill.restored(output, form, how)) == data


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab é\n\t\x1f", max_size=30))
def test_units_equal_the_expression(text):
    data = text.encode()
    ends, at = [], 0
    for unit in UNITS.findall(text):
        at += len(unit.encode())
        ends.append(at)
    assert infill.unit_ends(infill.np.frombuffer(data, infill.np.uint8)).tolist() == ends


@pytest.mark.parametrize("output,form", [(b"no sentinel", "psm"), (b"<P>a<S>b<M>c", "spm"), (b"<S>a<P>b<M>c", "psm"),
                                         (b"<P>a<M>b<S>c", "psm"), (b"x", "other")])
def test_outputs_of_another_form_are_refused(output, form):
    with pytest.raises(ValueError):
        infill.restored(output, form, Infill())


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "c", "d"), ("ab", "b", "c"), ("ab", "abc", "d")])
def test_sentinels_that_could_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        Infill(prefix=marks[0], suffix=marks[1], middle=marks[2])


# ---- URL filters

def plain_glob(glob: str, text: str) -> bool:
    plain = "".join({"**": ".*", "*": "[^/]*"}.get(p) or re.escape(p) for p in re.findall(r"\*\*+|\*|[^*]+", glob.replace("***", "**")))
    return re.fullmatch(plain, text, re.DOTALL) is not None


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.HOST_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict
    blocked = any(plain_glob(g, f".{host}{path}") for _, g in url_filter.GLOBS)
    return host, path, None, "block" if blocked else "allow"


URLS = [None, "", "no scheme", "http://", "http://com/", "http://com", "https://a.com/x?y#z", "https://EXAMPLE.com/en/1", "http://xexample.com/en/",
        "http://www.example.com/en/", "http://www.example.com/en", "https://m.www.example.com/en/q", "ftp://a.net/es/://b", "http://a.net/fr#es/",
        "http://net/es/", "http://a.net?/es/", "http://evil.org/x.com/", "http://ünï.net/es/é", "http://casino.org", "http://big-casino.org/a",
        "http://a.org/x/cgi-bin/y", "http://a.org/wp-login.php", "http://a.org/wp-login.phpx", "http://a.org/cart/1/checkout/2",
        "http://a.org/cart/1/2/checkout", "http://m.adult-x.org/de/", "http://a:80@b.com:81/x", "://x.com/", "http://a\nb.com/\nc",
        "http://a.org/" + "long/" * 60_000 + "cgi-bin/x", "http://a.org/" + "x" * 300_000, "http://spam-a.org/", "http://no-spam-a.org/"]


def test_urls_of_any_kind(spark):
    rows = [(i, url) for i, url in enumerate(URLS * 2)] + [(None, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({name: F.lit("own") for name in CLASHES})
    for parts in (1, 4):
        found = url_filter.judge(pages.repartition(parts)).collect()
        got = sorted((str(r["row"]["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in found)
        assert got == sorted((str(i), *[str(x) if k == 2 else x for k, x in enumerate(plain_verdict(url))]) for i, url in rows)
    assert {r["row"]["verdict"] for r in found} == {"own"}
    assert url_filter.judge(pages.limit(0)).collect() == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="ab/*", min_size=1, max_size=90), min_size=1, max_size=12),
       st.lists(st.text(alphabet="ab/é", max_size=30), min_size=1, max_size=12), st.sampled_from([70, 8192]))
def test_automaton_equals_expressions(globs, texts, bits):
    """Patterns that cross words, many to a pack and many packs; few and many texts together."""
    kept, url_filter.PACK_BITS = url_filter.PACK_BITS, bits
    try:
        filters = url_filter.Filters(rules=(), globs=tuple(("block", g) for g in globs))
        found = filters.first([t.encode() for t in texts])
    finally:
        url_filter.PACK_BITS = kept
    order = [glob for _, _, glob in filters.ordered]
    for text, at in zip(texts, found, strict=True):
        assert at == next((i for i, g in enumerate(order) if plain_glob(re.sub(r"\*{3,}", "**", g), text)), -1)


def test_many_rules_in_packs():
    rules = tuple(("block", f"host{i}.example", f"/p{i}/") for i in range(3_000))
    filters = url_filter.Filters(rules=rules, globs=())
    assert len(filters.packs) > 4
    found = filters.first([f".www.host{i}.example/p{i}/x".encode() for i in range(0, 3_000, 100)] + [b".host1.example/p2/"])
    assert [filters.ordered[at][1] for at in found[:-1]] == [f"host{i}.example/p{i}/" for i in range(0, 3_000, 100)]
    assert found[-1] == -1


# ---- Merkle manifest

def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fan):
    """Top of a tree, and per leaf the siblings to the left and right on every level."""
    proofs, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for proof, place in zip(proofs, at, strict=True):
            start = place // fan * fan
            proof.append(("".join(level[start:place]), "".join(level[place + 1:start + fan])))
        level = [sha("".join(level[i:i + fan])) for i in range(0, len(level), fan)]
        at = [place // fan for place in at]
    return level[0], proofs


def plain_manifest(rows, fan):
    def tree(row):
        return (row[3] is not None, (row[3] or "").encode())

    made = [(row, plain_leaf(row[0], row[3], row[2], row[4], row[1])) for row in rows]
    made.sort(key=lambda r: (tree(r[0]), r[0][0] is not None, r[0][0] or 0, r[1]))
    trees = [list(own) for _, own in groupby(made, key=lambda r: tree(r[0]))]
    tops = [plain_tree([digest for _, digest in own], fan) for own in trees]
    root, upper = plain_tree([top for top, _ in tops], fan)
    return sorted((str(row[0]), str(row[3]), digest, top, root, tuple(proof + above))
                  for own, (top, proofs), above in zip(trees, tops, upper, strict=True)
                  for (row, digest), proof in zip(own, proofs, strict=True))


VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def found_manifest(docs, shape):
    found = merkle.prove(merkle.manifest(docs, VALUES, shape=shape))
    found = found.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] for r in found)
    return sorted((str(r["key"]), str(r["source"]), r["leaf"], r["subroot"], r["root"],
                   tuple((s["left"], s["right"]) for s in r["proof"])) for r in found)


def test_manifest_of_messy_rows(spark):
    docs = spark.createDataFrame(MESSY, SCHEMA).withColumns({name: F.lit("own") for name in CLASHES})
    assert found_manifest(docs, merkle.Shape()) == plain_manifest(MESSY, 16)
    stored = merkle.manifest(docs.limit(0), VALUES)
    assert stored.root is None and merkle.prove(stored).collect() == []


@pytest.mark.parametrize("shape,counts", [(merkle.Shape(16, 2), (1, 15, 16, 17, 256, 257, 300)), (merkle.Shape(2, 2), (1, 2, 3, 4, 5, 17, 33)),
                                          (merkle.Shape(2, 3), (8, 9, 64, 65)), (merkle.Shape(3, 1), tuple(range(1, 12)))])
def test_manifest_equals_plain_trees(spark, shape, counts, monkeypatch):
    """Trees that end on, before and after a stored level; more sources than one node holds; several ranges."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", (50, 50))
    rows = [(i, f"text {i}", "en", f"src{n}", i) for n in counts for i in range(n)]
    rows += [(5, "same", "en", "hot", 4)] * 40  # rows equal in everything
    assert found_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), shape) == plain_manifest(rows, shape.fan)


def test_tampered_rows_do_not_verify(spark):
    rows = [(i, f"Text {i}", "en", f"src{i % 3}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lowered = merkle.leaf(*[F.lower("text") if name == "text" else F.col(name) for name in VALUES])
    found = merkle.prove(merkle.manifest(docs, VALUES, claim=F.when(F.col("doc_id") % 4 == 0, lowered)))
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("proof"))
    assert {(r["key"] % 4 == 0, r["ok"]) for r in found.select("key", (folded == F.col("root")).alias("ok")).collect()} == {
        (True, False), (False, True)}
