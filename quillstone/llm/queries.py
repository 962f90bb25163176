"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, manifest, near, packing, pii, runs, secrets, sharding, token_store, topk, toxicity, urls
from .common import fold, let, scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_read(spark, sf_dir, "documents").select("doc_id", "text"), pii.configured_key(spark)).select("doc_id", "n_entities", F.col("surrogate_text").alias("text"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind, *_ in secrets.BASE),
        F.sha2(secrets.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(secrets.ordered(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )


#: The rules that the contract names.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(finite, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)))
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(_read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.clean(decontamination.find_hits(docs, _read(spark, sf_dir, "benchmark")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.array_join(F.transform("hit_spans", lambda s: F.concat_ws(":", *(s[c].cast("string") for c in ("start", "end", "word", "word_end")))), ",").alias("hit_spans"),
        F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = langid.sample(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which by the contract a tenth of the documents repeat p words from the word a on: both follow from the crc32 of the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, planted)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_with_planted_runs(_read(spark, sf_dir, "documents")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    length = -F.col("longest.less")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("-longest.less * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed_text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    leaf, cut = manifest.leaf(*fields(F.col("text"))), F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = (fold("doc_id", 2) == 0) & F.contains(F.col("text"), F.lit("\n"))
    docs = docs.withColumn("tampered", F.when(tampered, manifest.leaf(*fields(cut))))
    made = manifest.build(docs, leaf, keep=("tampered",)).withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_pii_surrogates, op3_secret_scans, op4_url_filters, op5_exact_top_k, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_best_fit_packing, op9_language_id, op10_token_binary_output, op11_periodic_runs, op12_merkle_manifest, op13_sharding)}

_BASE = " UNION ALL ".join(
    f"SELECT r, doc_id, {i} AS place, '{kind}' AS kind, {group} AS grp, {least} AS least, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM d"
    for i, (kind, p, group, least) in enumerate((k, p.replace("'", "''"), g, n) for k, p, g, n in [*secrets.BASE, ("candidate", secrets.CANDIDATE, 0, 20)])
)

#: A field of a leaf.
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
             s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
             r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
        SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM r WHERE x = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE x = doc_id) AS n_links FROM documents
    """,
    "op7_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w, regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS gaps FROM documents),
             i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("text")}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
             v AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
             x AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, (SELECT DISTINCT n FROM v)),
             h AS (SELECT r, k, x.n, item FROM x JOIN v ON v.n = x.n AND v.win = array_to_string(w[k:k + x.n - 1], ' ')),
             hit AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS k FROM h),
             at_word AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS v, unnest(gaps[1:len(w)]) AS gap FROM d WHERE len(w) > 0),
             placed AS (SELECT r, k, CAST(sum(length(v) + length(gap)) OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS e, length(v) AS n FROM at_word),
             run AS (SELECT r, k, e - n AS s, e, k - row_number() OVER (PARTITION BY r ORDER BY k) AS grp FROM placed JOIN hit USING (r, k)),
             span AS (SELECT r, min(s) AS s, max(e) AS e, min(k) - 1 AS a, max(k) AS b FROM run GROUP BY r, grp),
             cut AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM span),
             o AS (SELECT r, sum(b - a) AS n_hit, string_agg(s || ':' || e || ':' || a || ':' || b, ',' ORDER BY s) AS hit_spans, string_agg(substr(t, before + 1, s - before), '' ORDER BY s) || substr(any_value(t), max(e) + 1) AS clean FROM cut JOIN d USING (r) GROUP BY r),
             n AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(hit_spans, '') AS hit_spans, sha256(coalesce(clean, t)) AS clean_sha256
        FROM d LEFT JOIN o USING (r) LEFT JOIN n USING (r)
    """,
    "op3_secret_scans": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
             m AS ({_BASE}),
             u AS (SELECT r, place, kind, grp, least, unnest(ms) AS v, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
             placed AS (SELECT *, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY r, place ORDER BY i) AS BIGINT) AS e FROM u),
             s AS (SELECT r, place, kind, v, e - length(v) AS b, e FROM placed WHERE length(CASE WHEN grp = 1 THEN regexp_extract(v, '{secrets.BASE[0][1].replace("'", "''")}', 1) ELSE v END) >= least),
             c AS (SELECT r, b, e, v, regexp_matches(v, '^[0-9a-fA-F]+$') AS hex FROM s
                   WHERE kind = 'candidate' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND replace(v, v[1], '') <> ''
                     AND NOT regexp_matches(v, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') AND NOT regexp_matches(v, '^[0-9/_.=+-]*$') AND NOT regexp_matches(v, '^[A-Za-z/_.=+-]*$') AND NOT regexp_matches(v, '^/?([a-z]+[/_.-])+[a-z]*[0-9]{{0,4}}/?$')),
             w AS (SELECT r, b, e, hex, k, unnest(string_split(substr(v, k, 20), '')) AS x FROM (SELECT *, unnest(range(1, length(v) - 18)) AS k FROM c)),
             h AS (SELECT r, b, e, hex, log2(20) - sum(n * log2(n)) / 20 AS bits FROM (SELECT r, b, e, hex, k, x, count(*) AS n FROM w GROUP BY ALL) GROUP BY r, b, e, hex, k),
             found AS (SELECT r, place, kind, b, e FROM s WHERE kind <> 'candidate' UNION ALL
                       SELECT r, 4, CASE WHEN hex THEN 'hex_entropy' ELSE 'text_entropy' END, b, e FROM h GROUP BY r, b, e, hex HAVING max(bits) >= CASE WHEN hex THEN 3.0 ELSE 3.6 END),
             o AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                          string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) FILTER (place < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) AS spans FROM found GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)
    """,
    "op4_url_filters": """
        WITH h AS (SELECT page_id, coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             rules(says, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
             best AS (SELECT h.*, (SELECT max_by(rule, length(rule)) FROM rules r WHERE (h.host = r.h OR ends_with(h.host, '.' || r.h)) AND starts_with(h.path, r.p)) AS rule FROM h),
             ruled AS (SELECT b.*, r.says FROM best b LEFT JOIN rules r ON r.rule = b.rule),
             known AS (SELECT u, says, count(*) AS n, substr(md5(u), 1, 1) IN ('0', '1', '2') AS held FROM ruled GROUP BY u, says),
             apart AS (SELECT count(DISTINCT says || held) = 4 AS apart FROM known WHERE says IS NOT NULL),
             pos AS (SELECT u, says, n, held, chr(2) || u || chr(3) AS s, unnest(range(1, length(u) + 3)) AS i FROM known),
             gram AS (SELECT u, CASE WHEN NOT (held AND (SELECT apart FROM apart)) THEN says END AS says, n, substr(s, i, k) AS g, i + k > length(s) AS at_end FROM pos, range(1, 5) t(k) WHERE i + k <= length(s) + 1),
             c AS (SELECT g, substr(g, 1, length(g) - 1) AS c, CAST(sum(CASE WHEN says = 'allow' THEN n ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN says = 'block' THEN n ELSE 0 END) AS DOUBLE) AS b FROM gram WHERE says IS NOT NULL GROUP BY g),
             x AS (SELECT c, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM c GROUP BY c),
             y AS (SELECT *, CASE WHEN na > 0 THEN ta / (na + ta) ELSE 1.0 END AS ea, CASE WHEN nb > 0 THEN tb / (nb + tb) ELSE 1.0 END AS eb FROM x),
             z AS (SELECT *, ln(ea) - ln(eb) AS l FROM y),
             j AS (SELECT * FROM c JOIN z USING (c)),
             p1 AS (SELECT g, l, 1 / 256.0::DOUBLE AS la, 1 / 256.0::DOUBLE AS lb, CASE WHEN na > 0 THEN a / (na + ta) + ea / 256 ELSE 1 / 256.0::DOUBLE END AS pa, CASE WHEN nb > 0 THEN b / (nb + tb) + eb / 256 ELSE 1 / 256.0::DOUBLE END AS pb FROM j WHERE length(g) = 1),
             p2 AS (SELECT j.g, j.l, q.pa AS la, q.pb AS lb, CASE WHEN na > 0 THEN a / (na + ta) + ea * q.pa ELSE q.pa END AS pa, CASE WHEN nb > 0 THEN b / (nb + tb) + eb * q.pb ELSE q.pb END AS pb FROM j JOIN p1 q ON q.g = substr(j.g, 2) WHERE length(j.g) = 2),
             p3 AS (SELECT j.g, j.l, q.pa AS la, q.pb AS lb, CASE WHEN na > 0 THEN a / (na + ta) + ea * q.pa ELSE q.pa END AS pa, CASE WHEN nb > 0 THEN b / (nb + tb) + eb * q.pb ELSE q.pb END AS pb FROM j JOIN p2 q ON q.g = substr(j.g, 2) WHERE length(j.g) = 3),
             p4 AS (SELECT j.g, j.l, q.pa AS la, q.pb AS lb, CASE WHEN na > 0 THEN a / (na + ta) + ea * q.pa ELSE q.pa END AS pa, CASE WHEN nb > 0 THEN b / (nb + tb) + eb * q.pb ELSE q.pb END AS pb FROM j JOIN p3 q ON q.g = substr(j.g, 2) WHERE length(j.g) = 4),
             w AS (SELECT g, ln(pa) - ln(pb) - ln(la) + ln(lb) - l AS gram FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)),
             v AS (SELECT w.g, gram, coalesce(z.l, 0) AS context FROM w LEFT JOIN z ON z.c = w.g),
             sc AS (SELECT u, coalesce(sum(gram + CASE WHEN at_end THEN 0 ELSE context END), 0) / (length(u) + 2) + (SELECT l FROM z WHERE c = '') AS score FROM gram LEFT JOIN v USING (g) GROUP BY u),
             m AS (SELECT says, avg(score) AS mean, stddev_pop(score) AS sd FROM (SELECT * FROM ruled JOIN (SELECT DISTINCT u, held FROM known) USING (u) WHERE says IS NOT NULL AND (held OR NOT (SELECT apart FROM apart))) JOIN sc USING (u) GROUP BY says),
             t AS (SELECT (a.mean * b.sd + b.mean * a.sd) / (a.sd + b.sd) AS t FROM m a, m b WHERE a.says = 'allow' AND b.says = 'block')
        SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict FROM ruled JOIN sc USING (u), t
    """,
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_periodic_runs": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             c AS (SELECT *, len(w) AS n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(id, ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS h FROM d),
             g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM c),
             p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
             t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
             x AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM t WHERE n > 0),
             e AS (SELECT a.r, b.i - a.i AS q, a.i AS i FROM x a JOIN x b ON a.r = b.r AND a.w = b.w AND b.i > a.i),
             k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM e),
             s AS (SELECT r, q, min(i) AS s, max(i) + q + 1 AS e FROM k GROUP BY r, q, grp HAVING count(*) + q >= greatest(12, 2 * q)),
             u AS (SELECT r, s, e, min(q) AS q FROM s GROUP BY r, s, e),
             cut AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM u),
             o AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS left_over FROM x ANTI JOIN cut USING (r, i) GROUP BY r),
             f AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs, first(s ORDER BY s - e, s, q) AS s, first(e ORDER BY s - e, s, q) AS e, first(q ORDER BY s - e, s, q) AS q FROM u GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period, (e - s) * 1000 // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
        FROM t LEFT JOIN f USING (r) LEFT JOIN o USING (r)
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE c AS (SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS h FROM documents),
             b AS (SELECT doc_id, source, {" || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars"))} AS head, text, CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM c),
             l AS (SELECT doc_id, source, sha256(head || {_FIELD.format("text")}) AS leaf, sha256(head || {_FIELD.format("tampered")}) AS tampered FROM b),
             d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
             v AS (SELECT source, 0 AS h, i, n, leaf AS node FROM d
                   UNION ALL SELECT source, h + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM v WHERE n > 1 GROUP BY source, h, i // 3, n),
             s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, (SELECT max(h) FROM v) AS deep FROM v WHERE n = 1),
             u AS (SELECT deep, 0 AS h, i, n, subroot AS node FROM s
                   UNION ALL SELECT deep, h + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY deep, h, i // 3, n),
             a AS (SELECT d.source, d.i, h, string_agg(node, '' ORDER BY v.i) FILTER (v.i < own) AS before, string_agg(node, '' ORDER BY v.i) FILTER (v.i > own) AS after
                   FROM (SELECT source, i, h, i // CAST(pow(3, h) AS BIGINT) AS own FROM d, (SELECT DISTINCT h FROM v)) d JOIN v USING (h) WHERE d.source IS NOT DISTINCT FROM v.source AND v.i // 3 = own // 3 AND v.n > 1 GROUP BY ALL),
             z AS (SELECT s.source, h + deep + 1 AS h, string_agg(node, '' ORDER BY u.i) FILTER (u.i < own) AS before, string_agg(node, '' ORDER BY u.i) FILTER (u.i > own) AS after
                   FROM (SELECT source, deep, h, i // CAST(pow(3, h) AS BIGINT) AS own FROM s, (SELECT DISTINCT h FROM u)) s JOIN u USING (deep, h) WHERE u.i // 3 = own // 3 AND u.n > 1 GROUP BY ALL),
             w AS (SELECT d.source, d.i, list(struct_pack(b := coalesce(before, ''), e := coalesce(after, '')) ORDER BY h) AS way
                   FROM d JOIN (SELECT * FROM a UNION ALL SELECT d.source, d.i, z.h, z.before, z.after FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source) a ON d.source IS NOT DISTINCT FROM a.source AND d.i = a.i GROUP BY d.source, d.i),
             p AS (SELECT d.*, coalesce(way, []) AS way FROM d LEFT JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.i = w.i),
             f AS (SELECT source, i, way, tampered AS node, 1 AS k FROM p UNION ALL SELECT source, i, way, sha256(way[k].b || node || way[k].e), k + 1 FROM f WHERE k <= len(way))
        SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, sha256(array_to_string(list_transform(p.way, lambda x: x.b || x.e), '')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
        FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN f ON p.source IS NOT DISTINCT FROM f.source AND p.i = f.i AND f.k = len(f.way) + 1 JOIN u r ON r.n = 1
    """,
}
