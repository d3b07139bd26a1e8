"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fill_in_middle, html_extraction, language_id, lexical_search, ngram_jaccard, pii, quality_rules, sequence_packing, sharding, substring_dedup, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The place of a tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of surrogates over the test tables; production runs have a secret one.
TEST_KEY = "key-of-the-test-tables"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slots(_table(spark, sf_dir, "documents"), sharding.tree())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, vocabulary(), bpe.PATTERN, and_decode=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)
    return done.select("doc_id", "text", F.size("_pii_types").cast("long").alias("n_entities"), F.array_join(F.array_sort("_pii_types"), ",").alias("types"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, _table(spark, sf_dir, "labels")).drop("text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontamination.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return done.withColumn("contaminated", F.col("n_hit") > 0)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fitted(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", language_id.in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extraction.extract(_table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = Path(vocabulary("byte_bpe_50k.json")).read_text()
    pieces = sequence_packing.pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), blob, ids=False)
    return sequence_packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_byte_bpe, op4_pii, op5_quality_rules, op6_decontamination, op7_ngram_jaccard, op8_url_filters, op9_language_id, op10_html_extraction, op11_fill_in_middle, op12_best_fit_packing, op13_lexical_search)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s WHERE k IN (SELECT k FROM r)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
l AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP6_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP6 = rf"""
WITH b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_OP6_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
d AS (SELECT doc_id, {_OP6_WORDS} AS w FROM documents),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k))),
h AS (SELECT doc_id, i, s.n, item_id FROM s JOIN k ON s.n = k.n AND s.k = k.k),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def _op8() -> str:
    """Every pattern rule's regular expression on every URL."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = sorted(url_filters.PATH_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    patterns = ", ".join(f"('{r}')" for r in url_filters.PATTERN_RULES)
    return rf"""
WITH b AS (SELECT starts_with(pattern, '@@') AS allow, regexp_replace(lower(pattern), '^@@', '') AS body FROM (VALUES {patterns}) AS t(pattern)),
m AS (SELECT allow, body, regexp_replace(regexp_replace(regexp_replace(body, '^[|]{{1,2}}', ''), '[|]$', ''), '([.+?$(){{}}\\|\[\]])', '\\\1', 'g') AS t FROM b),
g AS (SELECT allow, CASE WHEN starts_with(body, '||') THEN '{url_filters.HOST_START}' WHEN starts_with(body, '|') THEN '^' ELSE '' END
 || replace(replace(replace(t, '*', chr(1)), '^', '{url_filters.SEPARATOR}'), chr(1), '.*') || CASE WHEN ends_with(body, '|') THEN '$' ELSE '' END AS regex FROM m),
f AS (SELECT url, bool_or(allow) AS allow FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) JOIN g ON regexp_matches(lower(url), regex, 's') GROUP BY url),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE {rule} END AS rule,
CASE {verdict} WHEN f.allow THEN 'allow' WHEN NOT f.allow THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN f USING (url)
"""


_OP11 = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
u AS (SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, t,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP6_WORDS} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, {_OP6_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(w) AS t FROM i) GROUP BY i, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * c.n + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * c.n) // c.l AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT i, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s JOIN m USING (r) JOIN i USING (i) WHERE score > 0 QUALIFY rank <= 20
"""


#: Level by level, the least -ln(u) / weight of all children; the checksum by its table, byte by byte.
def _op1() -> str:
    nodes = sharding.tree()
    leaf = []

    def walk(children, path, above, into):
        for n in children:
            key = f"{path}/{n[0]}"
            (walk(n[1], key, [*above, key], into) if isinstance(n[1], list) else into.append(([*above, key], n[2])))

    def shard(tree) -> str:
        leaf.clear()
        walk(tree, "", [], leaf)
        weights = {}
        for keys, _ in leaf:
            for k in keys:
                weights[k] = weights.get(k, 0) + 1.0

        def choose(prefix, depth):
            below = sorted({keys[depth] for keys, _ in leaf if keys[:depth] == prefix}, key=[keys[depth] for keys, _ in leaf if keys[:depth] == prefix].index)
            then = [str(next(s for keys, s in leaf if keys == [*prefix, k])) if len(prefix) == 2 else choose([*prefix, k], depth + 1) for k in below]
            if len(below) == 1:
                return then[0]
            draws = [f"(-ln((('0x' || substr(md5(k || '|{k}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {weights[k]})" for k in below]
            cases = " ".join(f"WHEN {' AND '.join(f'{d} <= {o}' for o in draws[i + 1 :])} THEN {t}" for i, (d, t) in enumerate(zip(draws[:-1], then[:-1])))
            if len(below) > 2:
                least = f"least({', '.join(draws)})"
                cases = " ".join(f"WHEN {d} = {least} THEN {t}" for d, t in zip(draws[:-1], then[:-1]))
            return f"CASE {cases} ELSE {then[-1]} END"

        return choose([], 0)

    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, size, xor(list_reduce(list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM d, t),
s AS (SELECT doc_id, k, size, text_crc32, ({shard(nodes)})::INTEGER AS shard, ({shard(sharding.grown(nodes))})::INTEGER AS grown_shard, ('0x' || substr(md5(concat_ws('|', k, size, text_crc32)), 1, 3))::INTEGER AS bucket FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM s
"""


ORACLE_SQL = {"op1_sharding": _op1(), "op2_substring_dedup": _OP2, "op6_decontamination": _OP6, "op7_ngram_jaccard": _OP7, "op8_url_filters": _op8(), "op11_fill_in_middle": _OP11, "op13_lexical_search": _OP13}
