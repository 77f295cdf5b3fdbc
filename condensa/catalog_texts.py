"""Queries of tables of phrases, JSON in prose, learned aliases, fragments, factoring and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _SENT, _SQUEEZE, _query
from .functions import text as T
from .operators import chunks, constraints, factoring, fragments, jsontext, macros, paraphrases, phrases
from .sources import io

#: Units of a text in SQL: words, and other characters one by one.
_UNITS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]')"
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')"


@_query("documents benchmark", rf"""
WITH RECURSIVE b AS (SELECT lower(concat_ws(' ', w[i], w[i + 1], CASE WHEN i % 3 = 0 THEN w[i + 2] END)) p, lower(w[i]) c FROM (SELECT w, unnest(range(1, len(w))) i FROM (SELECT {_WORDS} w FROM benchmark))),
g AS (SELECT trim(p, ' ') p, min(c) || '-' c, len({_UNITS.format("trim(p, ' ')")}) k FROM b GROUP BY 1, 3),
w AS (SELECT doc_id, generate_subscripts(u, 1) i, unnest(u) w FROM (SELECT doc_id, {_UNITS.format("text")} u FROM documents)),
e AS (SELECT doc_id, i, w, string_agg(w, '') OVER x3 t3, string_agg(w, '') OVER x5 t5 FROM w WINDOW x3 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), x5 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
-- the longest phrase at each place: two words and a space, or three and two
m AS (SELECT doc_id, i, coalesce(b.k, a.k) k, coalesce(b.c, a.c) c, CASE WHEN b.k IS NULL THEN t3 ELSE t5 END f FROM e LEFT JOIN g a ON lower(t3) = a.p AND a.k = 3 LEFT JOIN g b ON lower(t5) = b.p AND b.k = 5 WHERE a.k IS NOT NULL OR b.k IS NOT NULL),
o AS (SELECT doc_id, list(struct_pack(i := i, k := k, c := c, f := f) ORDER BY i) l FROM m GROUP BY 1),
-- what is taken from left to right
t AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1].i >= a[-1].i + a[-1].k THEN list_concat(a, x) ELSE a END)) x FROM o),
r AS (SELECT doc_id, x.i i, CASE WHEN x.f = upper(x.f) AND x.f <> lower(x.f) THEN upper(x.c) WHEN x.f <> lower(x.f) AND x.f[1] = upper(x.f[1]) AND x.f[2:] = lower(x.f[2:]) THEN upper(x.c[1]) || x.c[2:] ELSE x.c END c FROM t),
h AS (SELECT doc_id, unnest(range(x.i + 1, x.i + x.k)) i FROM t),
z AS (SELECT doc_id, count(r.c) n, string_agg(CASE WHEN h.i IS NOT NULL THEN '' ELSE coalesce(r.c, w) END, '' ORDER BY i) text FROM w LEFT JOIN r USING (doc_id, i) LEFT JOIN h USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_replaced, coalesce(z.text, d.text) AS text FROM documents d LEFT JOIN z USING (doc_id)""")
def canonical_table(documents, benchmark):
    # every two or three neighbouring words of the benchmark are a phrase
    words = benchmark.select(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)).alias("w")).where("size(w) > 1")
    runs = words.select("w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("i")).selectExpr("lower(concat_ws(' ', w[i - 1], w[i], if(i % 3 = 0, get(w, i + 1), null))) phrase", "lower(w[i - 1]) c")
    table = runs.groupBy("phrase").agg(F.concat(F.min("c"), F.lit("-")).alias("canonical"))
    return phrases.replaced_by_table(documents, table)


# --- JSON in prose

_JSON = """concat(coalesce(source, ''), ' {note ', '{"id": ', doc_id, ', "lang": "', coalesce(lang, '?'), '", "say": "a ', chr(92), '"{x}', chr(92), '" [", "n": [1, {"deep": [true, null]}, "', coalesce(source, ''), '"]}', ' and [', n_chars, ', "b"] [1, {"open": 2} ', substring(text, 1, 200))"""


@_query("documents", f"""
WITH t AS (SELECT doc_id, {_JSON} t FROM documents),
b AS (SELECT doc_id, t, unnest(list_filter(range(1, length(t) + 1), lambda i: t[i] IN ('{{', '['))) i FROM t),
e AS (SELECT doc_id, t, i, list_filter(list_transform(list_filter(range(i + 1, length(t) + 1), lambda j: t[j] IN ('}}', ']')), lambda j: CASE WHEN json_valid(t[i : j]) THEN j END), lambda j: j IS NOT NULL)[1] j FROM b),
v AS (SELECT doc_id, i, j, t[i : j] s FROM e WHERE j IS NOT NULL),
-- a value that begins inside another isn't a block
o AS (SELECT doc_id, i, j, s, max(j) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) upto FROM v)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block, CAST(CAST(s AS JSON)::JSON AS VARCHAR) AS spelled, CAST(json(s) AS VARCHAR) AS text FROM o WHERE upto IS NULL OR i > upto""".replace("CAST(CAST(s AS JSON)::JSON AS VARCHAR) AS spelled, ", ""))
def json_blocks(documents):
    rows = jsontext.parts(documents.select("doc_id", F.expr(_JSON).alias("text"))).where("kind = 'json'")
    return rows.select("doc_id", F.expr("row_number() over (partition by doc_id order by part)").cast("long").alias("block"), "text")


@_query("documents", f"""SELECT doc_id, concat(source, ' {{note ', '{{"id":', doc_id, ',"lang":"', upper(lang), '","say":"a \\"{{x}}\\" [","n":[1,{{"deep":[true,null]}},"', source, '"]}}', ' and [', n_chars, ',"b"] [1, {{"open":2}} ', text[1:200]) AS text FROM (SELECT doc_id, coalesce(source, '') source, coalesce(lang, '?') lang, n_chars, text FROM documents)""")
def json_rewrapped(documents):
    """Strings under lang are rewritten, others stay as they are spelled."""
    rows = jsontext.parts(documents.select("doc_id", F.expr(_JSON).alias("text")), {"default": False, "minify": True, "overrides": {"lang": True, "**.deep.**": False}})
    return jsontext.joined(rows.withColumn("text", F.when(F.col("kind") == "string", F.upper("text")).otherwise(F.col("text"))))


# --- forced spans and constraints

_FORCED = {"caps": "[A-Z][A-Z]+", "link": r"https?://[^ \n]+", "pair": "[A-Za-z]+[@:=][A-Za-z0-9.]+"}
_KINDS = [*_FORCED.values(), constraints.DIGITS]


@_query("documents", f"""
WITH m AS ({" UNION ALL ".join(f"SELECT doc_id, {i} o, generate_subscripts(f, 1) k, unnest(f) v, unnest(g[: len(f)]) g FROM (SELECT doc_id, regexp_extract_all(text, '{p}') f, string_split_regex(text, '{p}') g FROM documents)" for i, p in enumerate(_KINDS))}),
s AS (SELECT doc_id, o, v, sum(length(g) + length(v)) OVER (PARTITION BY doc_id, o ORDER BY k) e FROM m),
l AS (SELECT doc_id, list(struct_pack(s := e - length(v), n := -length(v), o := o, e := e, v := v) ORDER BY e - length(v), -length(v), o) l FROM s GROUP BY 1),
f AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) ELSE a END)) x FROM l)
SELECT doc_id, ['{"', '".join([*_FORCED, "digits"])}'][x.o + 1] AS name, CAST(x.s AS BIGINT) AS start, CAST(x.e AS BIGINT) AS "end", x.v AS value FROM f""")
def forced_spans(documents):
    return constraints.forced_spans(documents, _FORCED)


_SEG = f"SELECT doc_id, {_SQUEEZE.format('s')} said FROM (SELECT doc_id, unnest({_SENT}) s FROM documents)"
_NEGATED, _MUST, _SHOULD, _DO_NOT = (constraints.whole(p).replace("'", "''") for p in (constraints.NEGATIONS, constraints.MUST, constraints.SHOULD, constraints.DO_NOT))
_SKIP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*constraints.STOPWORDS, *constraints.NEGATIONS}))
_PRINT = f"""s AS ({_SEG}), a AS (SELECT doc_id, said, list_filter(regexp_extract_all(said, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_SKIP}))[:8] anchors, regexp_extract_all(said, '{constraints.NUMBER}') numbers FROM s WHERE length(said) > 0),
c AS (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(said, '{_NEGATED}') THEN 'negation' END, CASE WHEN regexp_matches(said, '[0-9]') THEN 'numeric' END, CASE WHEN regexp_matches(said, '{_MUST}') THEN 'must' WHEN regexp_matches(said, '{_SHOULD}') THEN 'should' END, CASE WHEN regexp_matches(said, '{_DO_NOT}') THEN 'do_not' END], lambda k: k IS NOT NULL)) kind, said, anchors, numbers FROM a
 UNION ALL SELECT DISTINCT doc_id, 'quoted', said, [], [] FROM (SELECT doc_id, {_SQUEEZE.format("q[2 : length(q) - 1]")} said FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{constraints.QUOTED.replace("'", "''")}')) q FROM documents)) WHERE length(said) > 0)"""


@_query("documents", f"WITH {_PRINT} SELECT doc_id, kind, said, array_to_string(anchors, ' ') AS anchors, array_to_string(numbers, ' ') AS numbers FROM c")
def constraint_fingerprint(documents):
    return constraints.fingerprint(documents).select("doc_id", "kind", "said", F.array_join("anchors", " ").alias("anchors"), F.array_join("numbers", " ").alias("numbers"))


_CUT = "substr(text, 1, CAST(floor(length(text) * 0.6::DOUBLE) AS BIGINT))"


@_query("documents", f"""WITH {_PRINT}, r AS (SELECT doc_id, {_SQUEEZE.format(f"replace(coalesce({_CUT}, ''), ' not ', ' ')")} now FROM documents),
l AS (SELECT c.doc_id, kind, said, now, anchors[:4] w, numbers FROM c JOIN r ON r.doc_id = c.doc_id),
p AS (SELECT *, len(w) = 0 OR len(list_filter(w, lambda x: contains(now, x))) > 0 stands, CASE WHEN len(w) = 0 THEN regexp_matches(now, '{_NEGATED}') ELSE len(list_filter(w, lambda x: contains(now, x) AND regexp_matches(substr(now, greatest(instr(now, x) - 80, 1), least(instr(now, x) - 1, 80) + 80), '{_NEGATED}'))) > 0 END negated FROM l)
SELECT doc_id, kind, CASE WHEN kind = 'should' THEN 'advisory' ELSE 'mandatory' END AS severity, said, CASE kind WHEN 'quoted' THEN 'missing_literal' WHEN 'numeric' THEN 'missing_or_changed_numeric_constraint' WHEN 'must' THEN 'missing_must_directive' WHEN 'should' THEN 'missing_should_directive' ELSE 'polarity_violation' END AS reason
FROM p WHERE NOT CASE kind WHEN 'quoted' THEN contains(now, said) WHEN 'numeric' THEN stands AND len(list_filter(numbers, lambda x: NOT contains(now, x))) = 0 WHEN 'must' THEN stands WHEN 'should' THEN stands ELSE negated END""")
def constraint_violations(documents):
    """Constraints that the first three fifths of each text, without some of its negations, don't keep."""
    cut = F.replace(F.substring("text", F.lit(1), F.floor(F.length("text") * 0.6).cast("int")), F.lit(" not "), F.lit(" "))
    return constraints.violations(constraints.fingerprint(documents), documents.select("doc_id", cut.alias("text")))


# --- fragments, macros and factoring


@_query("documents", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') t FROM documents), l AS (SELECT doc_id, t, len(t) n, CASE WHEN len(t) > 5000 THEN 15 WHEN len(t) > 2000 THEN 18 ELSE 20 END k FROM t),
w AS (SELECT doc_id, i, md5(array_to_string(t[i : i + k - 1], ' ')) g FROM (SELECT doc_id, t, k, unnest(range(1, n - k + 2)) i FROM l WHERE n >= 2 * k)),
p AS (SELECT doc_id, i, min(i) OVER x f, count(*) OVER x c FROM w WINDOW x AS (PARTITION BY doc_id, g)),
e AS (SELECT p.doc_id, f, c, coalesce(list_position(list_transform(range(0, n - i + 1), lambda d: t[f + d] = t[i + d]), false) - 1, n - i + 1) z FROM p JOIN l ON l.doc_id = p.doc_id WHERE c > 1 AND i > f)
SELECT doc_id, f - 1 AS first, c AS n, min(z) AS size FROM e GROUP BY 1, 2, 3""")
def repeated_fragments(documents):
    return fragments.repeated_fragments(documents)


@_query("documents")
def fragment_compression(documents):
    return fragments.without_copies(documents)


_ROUND = r"[\p{L}\p{M}\p{N}ꞏ]+"


@_query("documents", f"""
WITH r AS (SELECT unnest(regexp_extract_all(text, '{_ROUND}(?: {_ROUND})+')) r FROM documents), w AS (SELECT string_split(r, ' ') w FROM r), p AS (SELECT w[i] a, w[i + 1] b FROM (SELECT w, unnest(range(1, len(w))) i FROM w))
SELECT a, b, count(*) AS n, (count(*) - 1) * (length(a) + length(b) + 1) AS saved FROM p WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= {macros.COMMON}""")
def macro_pairs(documents):
    return macros.pair_counts(F.col("text"), documents)


@_query("documents")
def macro_dictionary(documents):
    return macros.with_macros(documents, 3).select("doc_id", "text", F.size("legend").alias("n"), "saved", macros.restored(F.col("text"), F.col("legend")).alias("restored"))


@_query("orders")
def factored_lines(orders):
    """The orders of each customer, a line each, with what neighbouring lines share written once."""
    line = F.format_string("%s order %d of clerk %s is %s", F.regexp_replace("o_orderpriority", "^[0-9]-", ""), "o_orderkey", F.regexp_replace("o_clerk", "[^A-Za-z0-9]", ""), "o_orderstatus") if "o_clerk" in orders.columns else F.format_string("%s order with status %s has key %d", F.regexp_replace("o_orderpriority", "[^A-Z]", ""), "o_orderstatus", "o_orderkey")
    rows = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderstatus", "o_orderkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return factoring.factored_lines(rows, key="o_custkey").select("o_custkey", "text", F.size("marks").alias("groups"), "saved")


# --- chunks


@_query("documents", r"""
WITH c AS (SELECT doc_id, s, unnest(range(0, greatest(len(s) - 2, 1), 4)) b FROM (SELECT doc_id, string_split(text, '. ') s FROM documents)), k AS (SELECT doc_id, b // 4 chunk, s[b + 1 : b + 6] s FROM c),
b AS (SELECT doc_id, chunk, s, lag(s) OVER (PARTITION BY doc_id ORDER BY chunk) p FROM k)
SELECT doc_id, chunk, CAST(coalesce(list_max(list_filter([1, 2, 3], lambda i: i <= len(s) AND i <= len(p) AND s[: i] = p[len(p) - i + 1 :])), 0) AS INTEGER) AS shared FROM b""")
def chunk_boundaries(documents):
    return chunks.boundaries(chunks.fan_out(documents, 6, 2)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "shared")


@_query("documents")
def chunked_rewrite(documents):
    """Texts rewritten by chunks of eight sentences, each with its numbers behind placeholders that are different in the end."""

    def work(rows):
        found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
        masked = T.replaced(F.col("text"), "[0-9]+", lambda m: F.concat(F.lit("__NUM_"), (F.array_position(F.array_distinct(found), m) - 1).cast("string"), F.lit("__")))
        return rows.select("doc_id", "chunk", masked.alias("text"))

    return chunks.mapped(documents, work, 8, 1)


@_query("documents")
def training_labels(documents):
    """Labels of the words that each text keeps when its articles and its later copies go."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))
    short = fragments.without_copies(documents).select("doc_id", T.without_articles(F.col("text")).alias("short"))
    rows = documents.join(short, "doc_id").select("doc_id", words("text").alias("original"), words("short").alias("kept"))
    return io.keep_labels(rows, "doc_id").select("doc_id", F.size("tokens").alias("n"), F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("kept"))


@_query("documents")
def paraphrase_dedup(documents):
    return paraphrases.without_paraphrases(documents)


@_query("documents")
def post_chunk_dedup(documents):
    return paraphrases.after_chunks(documents)
