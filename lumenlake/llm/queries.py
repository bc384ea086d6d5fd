"""Queries of the training-data operators over whole tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import pii

    return pii.digest(pii.scan_pii(_docs(spark, sf_dir)))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import licenses

    docs = _docs(spark, sf_dir)
    return licenses.digest(licenses.scan_licenses(docs, licenses.train(licenses.background_of(docs))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import secret_scan

    return secret_scan.digest(secret_scan.scan_secrets(_docs(spark, sf_dir)))


#: Target weights of the mixture; sources not named here weigh DEFAULT_WEIGHT.
WEIGHTS = {"src0": 40, "src1": 15, "src2": 15, "src3": 12, "src4": 12}
DEFAULT_WEIGHT = 10


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import mixing

    return mixing.schedule(_docs(spark, sf_dir), WEIGHTS, default_weight=DEFAULT_WEIGHT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import toxicity

    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, ~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans")
    )


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import neardup

    return neardup.near_components(_docs(spark, sf_dir), shingle=3, percent=85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import quality

    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.assess(docs, quality.fit(docs, labels))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import substrings

    return substrings.remove_repeats(_docs(spark, sf_dir), window=35, with_text=False)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenlake.llm import store, tokenout

    path = store.new_path(spark, "tokens")
    tokenout.write_tokens(_docs(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenout.read_index(spark, path)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import decontam

    return decontam.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import lexical

    return lexical.rank_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_veccodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import veccodes

    return veccodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlake.llm import neighbours

    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    scored = neighbours.score_quality(docs, neighbours.fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_licenses, op3_secrets, op4_mixing, op5_toxicity, op6_neardup, op7_quality, op8_substrings, op9_tokens, op10_decontam, op11_lexical, op12_veccodes, op13_neighbours)
}
#: Words of each document, and their n-word windows, in DuckDB's SQL.
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _sets(table: str, key: str, n: int) -> str:
    """(key, s) of all distinct n-word shingles, lower-cased; the whole sequence where there are fewer words."""
    words = _WORDS.format(_FOLD.format("coalesce(text, '')"))
    return f"""SELECT DISTINCT {key}, CASE WHEN len(w) >= {n} THEN array_to_string(w[k + 1:k + {n}], ' ') ELSE array_to_string(w, ' ') || chr(10) END AS s
 FROM (SELECT {key}, w, unnest(range(0, greatest(len(w) - {n - 1}, 1))) AS k FROM (SELECT {key}, {words} AS w FROM {table})) WHERE len(w) > 0"""


_LIST = "{} || ':' || {} || ':' || {}"
#: Pattern and hashed value of each kind of secret; the last is a run with the equals signs after it.
_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SECRETS = ((_ASSIGN, f"regexp_extract(m, '{_ASSIGN}', 2)"), ("AKIA[A-Z0-9]+", "m"), ("[0-9a-f]{24,}", "m"), ("[A-Za-z0-9+/_-]{24,}=*", "m"))


def _spans(kind: int, pattern: str, value: str) -> str:
    """(row_no, kind_no, start, m, value, next) of all matches: ``next`` is what stands after one."""
    pieces = f"""SELECT row_no, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS h FROM d WHERE regexp_matches(text, '{pattern}')"""
    each = f"""SELECT row_no, p, h, unnest(range(1, len(h) + 1)) AS i FROM ({pieces})"""
    at = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT row_no, {kind} AS kind_no, ({at})::BIGINT AS start, h[i] AS m, {value.replace("(m,", "(h[i],") if value != "m" else "h[i]"} AS value, coalesce(nullif(p[i + 1], ''), h[i + 1], '') AS next FROM ({each})"""


def _pii_sql() -> str:
    """Matches of each kind, the texts between them, what stands round each, scores, and the digest."""
    from lumenlake.llm import pii

    word = lambda pattern: pattern.replace("(?i)\\b", r"(?i)(?:^|[^\p{L}\p{N}_])").removesuffix("\\b") + r"(?:$|[^\p{L}\p{N}_])"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    # Kinds whose pattern looks round itself are found place by place, in the few texts that may hold one.
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])*", "phone": pii.PHONE}
    found = [f"SELECT row_no, kind_no AS kind, start AS s, start + length(m) AS e, m FROM ({_spans(k, r, 'm')})" for k, r in enumerate(patterns.values())]
    found[2] += f" WHERE length({digits}) BETWEEN 13 AND 19"
    places = "SELECT row_no, text, unnest(range(1, length(text) + 1)) AS i FROM d WHERE regexp_matches(text, '{}')"
    found.append(f"""SELECT row_no, 4 AS kind, i - 1 AS s, i + 3 AS e, substring(text, i, 4) AS m FROM ({places.format("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{3}")})
 WHERE regexp_matches(substring(text, i, 26), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11}}') AND NOT (i > 1 AND regexp_matches(substring(text, i - 1, 1), '[A-Za-z0-9]'))""")
    found.append(f"""SELECT row_no, 5 AS kind, i - 1 AS s, i + 10 AS e, substring(text, i, 11) AS m FROM ({places.format("[0-9]{3}-[0-9]{2}-[0-9]{4}")})
 WHERE regexp_matches(substring(text, i, 11), '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') AND NOT (i > 1 AND regexp_matches(substring(text, i - 1, 1), '[0-9-]')) AND NOT regexp_matches(substring(text, i + 11, 1), '[0-9-]')""")
    luhn = f"""list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substring({digits}, (length({digits}) - i)::INT, 1)::INT
 ELSE 2 * substring({digits}, (length({digits}) - i)::INT, 1)::INT - CASE WHEN substring({digits}, (length({digits}) - i)::INT, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    sound = f"""CASE kind WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INT), 0) > 255)) = 0 WHEN 2 THEN {luhn}
 WHEN 3 THEN length({digits}) BETWEEN 9 AND 15 ELSE true END"""
    # The longest end at a word's end that has the country's length and leaves 1 modulo 97.
    country = " ".join(f"WHEN '{c}' THEN {n}" for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split())
    bare = "replace(substring(run, 1, n), ' ', '')"
    turned = f"substring({bare}, 5) || left({bare}, 4)"
    rest = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END)"
    grown = f"""SELECT row_no, s, max(s + n) AS e FROM (SELECT *, unnest(range(15, length(run) + 1)) AS n FROM (SELECT row_no, s, regexp_extract(substring(text, s + 1, 116), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}') AS run,
 substring(text, s + 1, 116) AS around FROM a WHERE kind = 4)) WHERE substring(run, n::INT, 1) <> ' ' AND NOT regexp_matches(substring(around, n::INT + 1, 1), '[A-Za-z0-9]')
 AND coalesce(CASE left(run, 2) {country} END, length({bare})) = length({bare}) AND {rest} = 1 GROUP BY 1, 2"""
    near = "CASE kind " + " ".join(f"WHEN {k} THEN regexp_matches(ctx, '{word(pii.CONTEXT[c])}')" for k, c in enumerate(pii.KINDS)) + " END"
    decoy = f"(regexp_matches(before, '{word(pii.DECOY)}') OR regexp_matches(value, '{word(pii.DECOY)}'))"
    prior = "CASE kind " + " ".join(f"WHEN {k} THEN {pii.PRIOR[c]}" for k, c in enumerate(pii.KINDS)) + " END"
    tells = r"(regexp_matches({0}, '\p{{L}}') OR length({0}) > 48)"
    said = _LIST.format("[" + ", ".join(f"'{k}'" for k in pii.KINDS) + "][kind + 1]", "s", "e")
    return f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents), x AS ({" UNION ALL ".join(found)}),
 q AS (SELECT *, coalesce(lag(e) OVER w, 0) AS prev, lead(s) OVER w IS NULL AS final FROM x WINDOW w AS (PARTITION BY row_no, kind ORDER BY s)),
 a AS (SELECT q.*, text, substring(text, prev + 1, s - prev) AS p, CASE WHEN final THEN substring(text, e + 1) END AS tail FROM q JOIN d USING (row_no)),
 t AS (SELECT * EXCLUDE (p, tail), coalesce(last_value(CASE WHEN {tells.format("p")} THEN right(p, 48) END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), '') || chr(10)
 || coalesce(first_value(CASE WHEN {tells.format("p")} THEN left(p, 48) END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
 max(CASE WHEN {tells.format("tail")} THEN left(tail, 48) END) OVER (PARTITION BY row_no, kind), '') AS near_ FROM a WINDOW w AS (PARTITION BY row_no, kind ORDER BY s)),
 g AS ({grown}),
 z AS (SELECT t.* EXCLUDE (e), CASE WHEN kind = 4 THEN g.e ELSE t.e END AS e FROM t LEFT JOIN g ON kind = 4 AND g.row_no = t.row_no AND g.s = t.s),
 c AS (SELECT row_no, kind, s, e, m, substring(text, s + 1, e - s) AS value, substring(text, greatest(prev, s - 48) + 1, s - greatest(prev, s - 48)) AS before,
 substring(text, greatest(0, s - 48) + 1, s - greatest(0, s - 48)) || chr(10) || substring(text, e + 1, 48) || chr(10) || near_ AS ctx FROM z WHERE e IS NOT NULL),
 f AS (SELECT row_no, kind, {said} AS said, s, least(1, {prior} + CASE WHEN {near} THEN 0.2 ELSE 0 END - CASE WHEN {decoy} THEN 0.3 ELSE 0 END) AS score FROM c WHERE {sound}),
 k AS (SELECT row_no, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{c}" for k, c in enumerate(pii.KINDS[:4]))}, string_agg(said, ',' ORDER BY kind, s) FILTER (kind < 4) AS base,
 string_agg(said, ',' ORDER BY kind, s) AS spans, count(*) FILTER (score >= 0.7) AS n_confident FROM f WHERE kind < 4 OR score >= {pii.ADDED_SCORE} GROUP BY 1)
 SELECT doc_id, {", ".join(f"coalesce(n_{c}, 0) AS n_{c}" for c in pii.KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_confident, 0) AS n_confident
 FROM d LEFT JOIN k USING (row_no)"""


def _codes_sql() -> str:
    """Four rounds of assignment and means over parts of vectors, one pair of tables for each."""
    near = lambda r: f"""SELECT vec_id, part, any_value(label) AS label, any_value(p.v) AS v, min({{'d': list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT, 'e': entry}}) AS hit
 FROM p JOIN c{r} AS c USING (part) GROUP BY 1, 2"""  # noqa: E731
    moved = lambda r: f"""SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM
 (SELECT part, hit.e AS entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM (SELECT part, hit, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2) AS m USING (part, entry)"""  # noqa: E731
    rounds = "".join(f", a{r} AS MATERIALIZED ({near(r)}), c{r + 1} AS MATERIALIZED ({moved(r)})" for r in range(4))
    return f"""WITH q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS v FROM (SELECT *, unnest(range(4)) AS part FROM q)),
 c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 256){rounds}, a4 AS MATERIALIZED ({near(4)}),
 e AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', hit.e), '' ORDER BY part) AS code, sum(hit.d)::BIGINT AS error FROM a4 GROUP BY vec_id)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256 FROM e"""


_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(_FOLD.format("text"))
ORACLE_SQL: dict[str, str] = {
    "op11_lexical": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), e AS (SELECT * FROM d WHERE len(t) > 0),
 s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM e), i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
 q AS (SELECT DISTINCT item, item_id, unnest(t) AS term FROM i), p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM e),
 tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, term),
 w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), s),
 x AS (SELECT r, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM tf JOIN w ON w.term = tf.term, s),
 y AS (SELECT item, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score FROM q JOIN x ON x.term = q.term GROUP BY item, r HAVING sum(part) > 0)
 SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM y) WHERE rank <= 10""",
    "op12_veccodes": _codes_sql(),
    "op6_neardup": f"""WITH RECURSIVE s AS ({_sets("documents", "doc_id", 3)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
 SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op8_substrings": f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 win AS (SELECT doc_id, k, md5(array_to_string(w[k + 1:k + 35], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) AS k FROM d)),
 hit AS (SELECT doc_id, k FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
 gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(k, k + 35)) AS p FROM hit) GROUP BY doc_id)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
 sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i - 1)) END, ' ')) AS kept_sha256
 FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id""",
    "op10_decontam": f"""WITH s AS ({_sets("documents", "doc_id", 5)}), t AS ({_sets("benchmark", "item_id", 5)}), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1)
 SELECT doc_id, t.item_id, count(*) AS n_shared, any_value(n) AS n_item FROM s JOIN t ON s.s = t.s JOIN n ON n.item_id = t.item_id
 GROUP BY doc_id, t.item_id HAVING count(*) * 100 >= 80 * any_value(n)""",
    # One step a slot: of the live sources' released blocks the one due first; a source's last block starts a new phase.
    "op4_mixing": f"""WITH RECURSIVE d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents),
 n AS (SELECT source, (max(r) // 16 + 1)::BIGINT AS blocks, CASE source {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT} END::BIGINT AS weight FROM d GROUP BY 1),
 l AS (SELECT list(source ORDER BY source IS NOT NULL, source) AS names, list(blocks ORDER BY source IS NOT NULL, source) AS blocks, list(weight ORDER BY source IS NOT NULL, source) AS weights FROM n),
 s AS (SELECT 0::BIGINT AS slot, 0::BIGINT AS t, list_transform(blocks, lambda b: 0::BIGINT) AS done, list_transform(blocks, lambda b: 0::BIGINT) AS taken, NULL::BIGINT AS i FROM l
 UNION ALL SELECT slot + 1, CASE WHEN done[k] + 1 = blocks[k] THEN 0 ELSE t + 1 END, list_transform(done, lambda x, j: x + (j = k)::BIGINT),
 CASE WHEN done[k] + 1 = blocks[k] THEN list_transform(taken, lambda x: 0::BIGINT) ELSE list_transform(taken, lambda x, j: x + (j = k)::BIGINT) END, k
 FROM (SELECT *, list_min(list_filter(list_transform(range(1, len(blocks) + 1), lambda j: CASE WHEN done[j] < blocks[j] AND taken[j] * total // weights[j] <= t
 THEN {{'due': ((taken[j] + 1) * total + weights[j] - 1) // weights[j], 'j': j}} END), lambda x: x IS NOT NULL)).j AS k
 FROM (SELECT s.*, blocks, weights, list_sum(list_transform(range(1, len(blocks) + 1), lambda j: CASE WHEN done[j] < blocks[j] THEN weights[j] ELSE 0 END))::BIGINT AS total FROM s, l)
 WHERE total > 0)),
 b AS (SELECT names[i] AS source, done[i] - 1 AS block_no, slot - 1 AS slot FROM s, l WHERE i IS NOT NULL),
 p AS (SELECT doc_id, d.source, r // 16 AS block_no, b.slot, r FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND r // 16 = b.block_no)
 SELECT doc_id, source, block_no::BIGINT AS block_no, slot::BIGINT AS slot, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM p""",
    # Positions of matches: each starts where all texts between matches and all matches before it end.
    "op3_secrets": f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
 x AS ({" UNION ALL ".join(_spans(k, *r) for k, r in enumerate(_SECRETS))}),
 f AS (SELECT * FROM x WHERE CASE kind_no WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 2 THEN length(m) >= 24
 ELSE length(rtrim(m, '=')) >= 24 AND length(m) - length(rtrim(m, '=')) <= 2 AND NOT (m LIKE '%=' AND regexp_matches(next, '^[A-Za-z0-9+/_-]'))
 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9].*[0-9]') END),
 o AS (SELECT value, count(DISTINCT owner) AS owners FROM f JOIN d USING (row_no) GROUP BY 1),
 j AS (SELECT f.*, owners < 3 AS live, {_LIST.format("['assign', 'access', 'hex', 'entropy'][kind_no + 1]", "start", "start + length(m)")} AS said FROM f JOIN o USING (value) WHERE kind_no < 3 OR owners < 3),
 g AS (SELECT row_no, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
 string_agg(said, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(said, ',' ORDER BY start, kind_no) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared FROM j GROUP BY 1)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN g USING (row_no)""",
    "op1_pii": _pii_sql(),
}
