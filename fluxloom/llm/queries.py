"""The registered queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from fluxloom.llm import (bpe, fingerprints, infill, kneser_ney, languages, main_text, merkle, mixing, near_duplicates, pii,
                          quality, risk_rules, url_filter)
from fluxloom.llm.common import held_out, single_threaded, table
from fluxloom.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` and its SQL twin."""

    def wrap(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            single_threaded()
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def _rules_sql() -> str:
    """The step of the path that each family takes, null where none is safe, and the verdict."""
    risk = risk_rules.Risk()
    p, path = risk.total_risk, risk_rules.settings(risk.rules)
    ratios = [f"(case when {r.bottom} > 0 then {r.top}::double / {r.bottom} else 0 end) {'>' if r.sign > 0 else '<'}" for r in risk.rules]
    steps = [" or ".join(f"{ratio} {cutoff}" for ratio, cutoff in zip(ratios, step, strict=True)) for step in path]
    fails = ", ".join(f"count(*) filter (where {step}) as k{i}" for i, step in enumerate(steps))
    sums = ", ".join(f"sum(k{i})::bigint as k{i}" for i in range(len(path)))
    tail = "list_sum(list_transform(range(0, k{0} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) " \
        f"- lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
    safe = " ".join(f"when {tail.format(i)} <= {risk.delta} / families then {i}" for i in range(len(path)))
    verdict = " ".join(f"when {i} then {step}" for i, step in enumerate(steps))
    return f"""
judged as (
    select lang, count(*) as n, {fails} from facts join labels using (doc_id)
    where quality = 1 and not base_failed group by lang),
sized as (select *, n < ceil(ln({risk.delta} / (count(*) over () + 1)) / ln(1 - {p})) as pooled from judged),
families as (
    select pooled, case when not pooled then lang end as lang, sum(n)::bigint as n, {sums} from sized group by 1, 2),
chosen as (
    select pooled, lang, case {safe} end as step from (select *, count(*) over () as families from families))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or coalesce(case case when c.pooled is null then p.step else c.step end {verdict} end, false)) as kept
from facts f left join chosen c on not c.pooled and c.lang is not distinct from f.lang left join chosen p on p.pooled
"""


@query("op1_quality_rules", f"""
with texts as (
    select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
windows as (
    select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
    from (select rid, words, unnest(range(1, len(words) - 1)) as i from texts)),
repeated as (select rid, i from windows qualify count(*) over (partition by rid, w) > 1),
covered as (
    select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from repeated) group by rid),
lines as (
    select rid, count(*) as n, count(*) - count(distinct line) as dup
    from (select rid, unnest(string_split(text, chr(10))) as line from texts)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
counted as (
    select doc_id, lang, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
        (length(text) - length(translate(text, '!', '')))::bigint as n_marks,
        coalesce(lines.n, 0)::bigint as n_lines, coalesce(lines.dup, 0)::bigint as n_dup_lines,
        coalesce(covered.n, 0)::bigint as n_repeat_words
    from texts left join lines using (rid) left join covered using (rid)),
facts as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
{_rules_sql()}
""")
def op1(spark, sf_dir):
    """Facts and verdict of every document; good labels choose the cutoffs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = risk_rules.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    """Ids of every document and what they decode to, as digests."""
    vocab = bpe.public_vocabulary()
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab), vocab)
    return found.select("row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op7_near_duplicates")
def op7(spark, sf_dir):
    """The class of every document, named by its least id."""
    found = near_duplicates.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


@query("op8_mixing", """
with recursive sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
        md5('8|' || coalesce(doc_id::varchar, 'null')) as draw
    from documents),
sources as (
    select source, sum(size)::bigint as source_size,
        [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
        row_number() over (order by source nulls last) as place
    from sized group by source),
capped as (  -- sources that reach their cap do so in order of cap / weight
    select *, 1.5 * sum(source_size) over () - coalesce(sum(2.0 * source_size) over before, 0) as rest,
        sum(weight) over () - coalesce(sum(weight) over before, 0) as open_weight,
        2.0 * source_size / weight as reach, row_number() over (order by 2.0 * source_size / weight, place) as rank
    from sources
    window before as (order by 2.0 * source_size / weight, place rows between unbounded preceding and 1 preceding)),
level as (select rest / open_weight as level from capped where reach >= rest / open_weight order by rank limit 1),
goals as (
    select source, source_size, round(least(2.0 * source_size, weight * level), 6) as target from capped, level),
parts as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes from goals),
keys as (
    select source, draw, sum(size) as size from sized group by source, draw),
placed as (
    select *, coalesce(sum(size) over (partition by source order by draw
        rows between unbounded preceding and 1 preceding), 0) as before from keys),
wanted as (
    select p.source, p.draw, p.size, g.source_size, g.target, part,
        (g.passes + (part > 0 and p.before + p.size <= part)::int)::int as times
    from placed p join (select *, target - passes * source_size as part from parts) g
        on g.source is not distinct from p.source),
rounds as (
    select 0 as round, * from wanted
    union all
    select round + 1, source, draw, size, source_size, target, part,
        times + (best or wanted > 0 and reach + wanted <= gap - best_size)::int as times
    from (
        select *, coalesce(sum(wanted) over (partition by source order by draw
            rows between unbounded preceding and 1 preceding), 0) as reach
        from (
            select *, case when fits and not best and times = least and size <= gap - best_size then size else 0 end as wanted
            from (
                select *, fits and row_number() over (partition by source order by fits desc, size desc, draw desc) = 1 as best,
                    max(case when fits then size end) over (partition by source) as best_size,
                    min(case when fits then times end) over (partition by source) as least
                from (
                    select *, part > 0 and times < 2 and size > 0 and size <= gap as fits
                    from (select *, target - sum(times * size) over (partition by source) as gap from rounds)))))
    where best_size is not null),
filled as (select * from rounds qualify round = max(round) over (partition by source)),
done as (
    select source, draw, source_size, target,
        (times + (open and row_number() over (partition by source order by open desc, size, draw) = 1
            and size - gap < gap)::int) as times
    from (select *, part > 0 and times < 2 and size > 0 as open,
            target - sum(times * size) over (partition by source) as gap from filled))
select s.doc_id, s.size, w.source_size, w.target::double as target, (s.size * w.times)::bigint as taken
from sized s join done w on w.source is not distinct from s.source and w.draw = s.draw
""")
def op8(spark, sf_dir):
    """How often each document is taken, from the shards that the operator gives it."""
    rows = mixing.assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("row.doc_id", "size", "source_size", "target",
                       (F.col("size") * F.size("shards")).alias("taken"))


@query("op2_html")
def op2(spark, sf_dir):
    """The main text of every page."""
    found = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op3_kneser_ney")
def op3(spark, sf_dir):
    """Scores of all texts by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 2, 7))
    model = kneser_ney.train(docs.filter("not held_out"))
    found = kneser_ney.score(docs, model)
    return found.select("row.doc_id", "row.held_out", "n_tokens", "n_known",
                        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _span_text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op4_pii")
def op4(spark, sf_dir):
    """Spans of the patterns and of the trained field; counts and digest are those of the patterns."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("redacted")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}")
              for kind in pii.KINDS]
    return found.select("row.doc_id", *counts, F.sha2(_span_text("base"), 256).alias("base_sha256"),
                        _span_text("spans").alias("spans"))


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    """Trees learned from the labelled rows that are not held out, and the score of every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 1, 3))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    found = quality.classify(docs, labels, learn_from="not row.held_out")
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_fingerprints")
def op9(spark, sf_dir):
    """Fingerprints of every text and its edited text, and their likeness."""
    found = fingerprints.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("key", "doc_id")


@query("op10_languages")
def op10(spark, sf_dir):
    """Profiles learned from the rows that are not held out, and the language of every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out("doc_id", 2, 4))
    profiles = languages.learn(docs.filter("not held_out"))
    found = languages.identify(docs.select("doc_id", "held_out", "text"), profiles)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("op11_infill", """
with cut as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units
    from documents),
drawn as (
    select *, len(units)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
        ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from cut),
placed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
            then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn),
blocks as (
    select *, coalesce(array_to_string(units[1:a], ''), '') as prefix, coalesce(array_to_string(units[a + 1:b], ''), '') as middle,
        coalesce(array_to_string(units[b + 1:n], ''), '') as suffix from placed)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
    case when form <> 'plain' then length(middle)::bigint end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from blocks
""")
def op11(spark, sf_dir):
    """Every text rearranged, and rebuilt from its output and form."""
    found = infill.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = infill.restore(found.select(F.col("row.doc_id"), "n", "form", "prefix_chars", "middle_chars", "output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def _glob_regex(glob: str) -> str:
    plain = "".join({"**": ".*", "*": "[^/]*"}.get(piece) or re.escape(piece) for piece in re.findall(r"\*\*|\*|[^*]+", glob))
    return f"(?s)\\A{plain}\\z"


def _globs_sql() -> str:
    """The verdict of the globs beside the host rules, the most literal first."""
    others = [rule for rule in url_filter.Filters().ordered if rule[1] is None]
    tests = " ".join(f"when regexp_matches('.' || host || path, '{_glob_regex(glob)}') then '{verdict}'"
                     for verdict, _, glob in others)
    return f"case {tests} else 'allow' end"


@query("op12_url_filters", f"""
with parts as (
    select page_id, coalesce(case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end, '') as rest
    from pages),
cut as (
    select page_id, regexp_extract(rest, '^[^/?#]*') as given, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) as after
    from parts),
named as (
    select page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(after, '^[^?#]*') as path from cut),
rules (verdict, h, p) as (values {', '.join(str(rule) for rule in url_filter.HOST_RULES)}),
fitting as (
    select n.*, r.h || r.p as rule, r.verdict,
        row_number() over (partition by page_id, host, path order by length(r.h || r.p) desc nulls last) as best
    from (select distinct * from named) n left join rules r on ('.' || n.host) like ('%.' || r.h) and starts_with(n.path, r.p))
select n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, {_globs_sql().replace('host', 'n.host').replace('path', 'n.path')}) as verdict
from named n join fitting f on f.page_id is not distinct from n.page_id and f.host = n.host and f.path = n.path and f.best = 1
""")
def op12(spark, sf_dir):
    """Host, path and verdict of every page."""
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("row.page_id", "host", "path", "rule", "verdict")


def _levels_sql(base: str, name: str, levels: int) -> str:
    """Nodes of every level of the trees over ``base`` (tree, pos, d, n), the tops, and the siblings on every level."""
    steps = [f"{name}0 as (select tree, pos, d, n from {base})"]
    for level in range(1, levels + 1):
        steps.append(f"""{name}{level} as (
    select tree, pos // 16 as pos, sha256(string_agg(d, '' order by pos)) as d, max((n + 15) // 16) as n
    from {name}{level - 1} where n > 1 group by tree, pos // 16)""")
    steps.append(f"{name}_tops as (" + " union all ".join(
        f"select tree, d from {name}{level} where n = 1" for level in range(levels + 1)) + ")")
    for level in range(levels):
        size = 16**level
        steps.append(f"""{name}_run{level} as (
    select b.tree, b.pos, coalesce(string_agg(x.d, '' order by x.pos) filter (where x.pos < b.pos // {size}), '') as l,
        coalesce(string_agg(x.d, '' order by x.pos) filter (where x.pos > b.pos // {size}), '') as r
    from {base} b join {name}{level} x on x.tree = b.tree and x.pos // 16 = b.pos // {size * 16} and x.n > 1
    group by b.tree, b.pos)""")
    return ",\n".join(steps)


def _crc32_sql(text: str) -> str:
    """The checksum of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: " \
        f"list_transform(range(0, 8), lambda j: (ord(({text})[i])::bigint >> j) & 1)))"
    step = "xor(crc >> 1, case when (xor(crc, bit) & 1) = 1 then 3988292384 else 0 end)"
    return f"xor(list_reduce({bits}, lambda crc, bit: {step}, 4294967295::bigint), 4294967295)"


LEVELS, TOP_LEVELS = 4, 2  # of the SQL: trees of up to 65,536 leaves and 256 sources


def _merkle_sql() -> str:
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [(f"r{i}.l", f"r{i}.r") for i in range(LEVELS)] + [(f"u{i}.l", f"u{i}.r") for i in range(TOP_LEVELS)]
    proof = " || ".join(f"coalesce({left} || {right}, '')" for left, right in steps)
    folds, start = [], "start"
    for i, (left, right) in enumerate(steps):
        folds.append(f"folded{i} as (select *, case when l{i} is null then {start} else sha256(l{i} || {start} || r{i}) end as f{i} "
                     f"from {f'folded{i - 1}' if i else 'joined'})")
        start = f"f{i}"
    sides = ", ".join(f"{left} as l{i}, {right} as r{i}" for i, (left, right) in enumerate(steps))
    joins = " ".join(f"left join t_run{i} r{i} on r{i}.tree = p.tree and r{i}.pos = p.pos" for i in range(LEVELS))
    joins += " join tops s on s.name = p.tree " + " ".join(
        f"left join s_run{i} u{i} on u{i}.pos = s.pos" for i in range(TOP_LEVELS))
    return f"""
with rows as (
    select doc_id, coalesce('1' || source, '0') as tree, sha256({head} || {field.format('text')}) as d,
        sha256({head} || {field.format(lower)}) as lowered, {_crc32_sql('doc_id::varchar')} % 5 = 0 as tampered from documents),
placed as (
    select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as pos,
        count(*) over (partition by tree) as n from rows),
{_levels_sql('placed', 't', LEVELS)},
tops as (
    select tree as name, 0 as tree, d, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from t_tops),
{_levels_sql('tops', 's', TOP_LEVELS)},
joined as (
    select p.doc_id, p.d as leaf, s.d as subroot, w.d as root, sha256({proof}) as proof_sha256, {sides},
        case when p.tampered then p.lowered else p.d end as start
    from placed p {joins} join s_tops w on true),
{', '.join(folds)}
select doc_id, leaf, subroot, root, proof_sha256, {start} as folded_root, {start} = root as verified from folded{len(steps) - 1}
"""


@query("op13_merkle", _merkle_sql())
def op13(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and what a partly tampered copy folds to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = merkle.leaf(*[F.translate("text", url_filter.UPPER, url_filter.LOWER) if name == "text" else F.col(name)
                            for name in values])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.prove(merkle.manifest(docs, values, claim=F.when(tampered, lowered)))
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("claim", "leaf"), F.col("proof")))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                        merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
