"""The queries over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontamination, html, licenses, mixing, neardup, preferences, quality, recipes, secrets, sharding, tokens, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.learn(docs), whole=True)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.gather_turns(table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(preferences.reply_pairs(turns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_table(spark))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(table(spark, sf_dir, "documents"), k=4)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_dedup(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_chat_format,
        op3_quality,
        op4_decontaminate,
        op5_html_text,
        op6_mixing,
        op7_licenses,
        op8_near_dedup,
        op9_exact_dedup,
        op10_sharding,
        op11_whitening,
        op12_vector_codes,
        op13_token_counts,
        pipeline,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(lower(coalesce({column}, '')), '{licenses.COPYRIGHT_LINE}', '', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for old, new in licenses.EQUIVALENT:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _whole_sql(column: str) -> str:
    out = rf"trim(regexp_replace({column}, '[ \n]+', ' ', 'g'))"
    for old, new in licenses.PHRASES:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _licenses_sql() -> str:
    """Without the long texts of ``licenses.WHOLE``; copyright notices are whole lines with a year."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in licenses.KNOWN)
    cut = rf"""list_transform(list_filter(regexp_split_to_array(c, '\n *\n[ \n]*'), lambda p: trim(replace(p, chr(10), ' ')) <> ''), lambda p: {{'t': {_whole_sql('p')}, 'several': contains(trim(p), chr(10))}})"""
    return rf"""
        WITH texts AS (SELECT DISTINCT l AS license_id, {_whole_sql('c')} AS t, {cut} AS ps FROM (SELECT l, {_canonical_sql('t')} AS c FROM (VALUES {known}) k(l, t))),
        known AS (SELECT DISTINCT license_id, t FROM texts),
        known_parts AS (SELECT license_id, ps AS variant, len(ps) AS k, unnest(ps).t AS t, generate_subscripts(ps, 1) AS kpos FROM texts),
        canon AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_sql('text')} AS c FROM documents),
        lines AS (SELECT r, doc_id, trim(unnest(string_split(c, chr(10)))) AS t FROM canon),
        full_lines AS (SELECT * FROM lines WHERE t <> ''),
        several AS (SELECT r FROM full_lines GROUP BY r HAVING count(*) > 1),
        units AS (SELECT doc_id, 'text' AS scope, {_whole_sql('c')} AS t FROM canon
                  UNION ALL SELECT doc_id, 'line', t FROM full_lines WHERE r IN (SELECT r FROM several)),
        cut AS (SELECT r, doc_id, {cut} AS ps FROM canon),
        parts AS (SELECT r, doc_id, len(ps) AS n, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM cut),
        runs AS (SELECT DISTINCT r, doc_id, license_id, max(stop) OVER (PARTITION BY r, doc_id, license_id, start) AS stop FROM (
                 SELECT r, doc_id, license_id, variant, k, pos - kpos AS start, pos - kpos + k AS stop FROM parts JOIN known_parts ON parts.p.t = known_parts.t
                 WHERE k < n AND (k > 1 OR p.several) GROUP BY ALL HAVING count(DISTINCT kpos) = k))
        SELECT doc_id, scope, license_id, count(*) AS matches FROM units JOIN known USING (t) WHERE t <> '' GROUP BY ALL
        UNION ALL SELECT doc_id, 'passage', license_id, count(*) FROM runs GROUP BY ALL"""


_CHAT_SQL = """
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
               FROM conversations WHERE conv_id IS NOT NULL),
    replies AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS nth, count(*) OVER (PARTITION BY conv_id) AS k FROM t WHERE role = 'assistant'),
    convs AS (SELECT t.conv_id, count(*) AS turns, max(r.n) AS upto, max(r.k) AS k FROM t LEFT JOIN replies r ON r.conv_id = t.conv_id AND r.n = t.n GROUP BY t.conv_id),
    pairs AS (SELECT c.conv_id, c.turns, c.upto, o.conv_id AS other, o.role AS o_role, o.text AS o_text, own.text AS own_text
              FROM convs c LEFT JOIN replies own ON own.conv_id = c.conv_id AND own.n = c.upto
              LEFT JOIN replies o ON c.upto IS NOT NULL AND o.conv_id = xor(c.conv_id, 1) AND o.nth = least(c.k, o.k)),
    cut AS (SELECT *, coalesce(upto - 1, turns) + CASE WHEN own_text = o_text THEN 1 ELSE 0 END AS prompt_turns FROM pairs),
    parts AS (SELECT cut.conv_id, t.n, t.n <= prompt_turns AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS w
              FROM cut JOIN t ON t.conv_id = cut.conv_id AND t.n <= coalesce(upto, turns)),
    texts AS (SELECT conv_id, coalesce(string_agg(w, '' ORDER BY n) FILTER (common), '') AS prompt, coalesce(string_agg(w, '' ORDER BY n) FILTER (NOT common), '') AS chosen FROM parts GROUP BY conv_id)
    SELECT conv_id AS pair_id, conv_id AS chosen_id, other AS rejected_id, CAST(prompt_turns AS INTEGER) AS prompt_turns, prompt, chosen,
           CASE WHEN o_text IS NULL OR own_text = o_text THEN '' ELSE '<|assistant|>' || chr(10) || o_text || '<|end|>' || chr(10) END AS rejected,
           CASE WHEN upto IS NULL OR own_text = o_text THEN '' ELSE '14:' || CAST(22 + length(own_text) AS VARCHAR) END AS chosen_mask,
           CASE WHEN o_text IS NULL OR own_text = o_text THEN '' ELSE '14:' || CAST(22 + length(o_text) AS VARCHAR) END AS rejected_mask
    FROM cut JOIN texts USING (conv_id)"""

_MIX_SQL = rf"""
    WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
    w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
                 sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
    l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
    c AS (SELECT *, (budget - before) / w_left * w >= cap AS capped FROM l),
    t AS (SELECT source, source_size, budget, CASE WHEN capped THEN cap ELSE
                 (budget - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (sum(w) FILTER (NOT capped) OVER ()) * w END AS target FROM c),
    q AS (SELECT doc_id, size, source_size, target, budget, row_number() OVER () AS r,
                 sum(size) OVER (PARTITION BY base.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
          FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT r, size, budget, CAST(k * source_size + upto AS DOUBLE) / target AS f FROM q, (VALUES (0), (1)) copies(k) WHERE size > 0),
    run AS (SELECT f, budget, sum(size) OVER (ORDER BY f) AS total FROM e),
    cut AS (SELECT max(f) AS f FROM run WHERE total <= budget)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * (SELECT count(*) FROM (VALUES (0), (1)) copies(k), cut WHERE q.size > 0 AND CAST(k * source_size + upto AS DOUBLE) / target <= cut.f) AS BIGINT) AS taken
    FROM q"""

_EXACT_SQL = r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    k AS (SELECT text_sha256, count(*) AS group_size, (arg_min(struct_pack(i := doc_id), struct_pack(a := -cp, b := doc_id IS NULL, c := coalesce(doc_id, 0)))).i AS keep_id FROM n GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN k USING (text_sha256)"""



def _codes_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """For vectors of ``parts`` times ``width`` entries."""
    steps = [
        rf"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        p AS MATERIALIZED (SELECT r, vec_id, part, x[part * {width} + 1 : part * {width} + {width}] AS v, list_inner_product(v, v) AS vv FROM k, range({parts}) t(part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(
            rf"""a{n} AS MATERIALIZED (SELECT r, p.part, min({{'d': vv - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), 'e': b.e}}) AS best FROM p JOIN b{n} b USING (part) GROUP BY ALL)"""
        )
        if n < rounds:
            steps.append(
                rf"""m{n} AS (SELECT part, best.e AS e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{n} JOIN p USING (r, part)),
        b{n + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.v, b{n}.v) AS v FROM b{n} LEFT JOIN (
            SELECT part, e, list(c ORDER BY i) AS v FROM (SELECT part, e, i, floor(sum(c) / count(*)) AS c FROM m{n} GROUP BY ALL) GROUP BY ALL) m USING (part, e))"""
            )
    return rf"""
        WITH {", ".join(steps)},
        books AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b{rounds})),
        coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN coded USING (r), books"""


SQL = {"op2_chat_format": _CHAT_SQL, "op6_mixing": _MIX_SQL, "op7_licenses": _licenses_sql(), "op9_exact_dedup": _EXACT_SQL, "op12_vector_codes": _codes_sql()}
