"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rolesift.llm.bpe import round_trip
from rolesift.llm.conversation_repair import repair_damaged
from rolesift.llm.decontamination import decontaminate
from rolesift.llm.exact_dedup import exact_duplicates
from rolesift.llm.jaccard_join import near_duplicates
from rolesift.llm.language_id import identify_languages
from rolesift.llm.line_dedup import drop_boilerplate
from rolesift.llm.quality import score_quality
from rolesift.llm.registry import ORACLE, QUERIES, query, read
from rolesift.llm.sharding import even_tree, shard_documents
from rolesift.llm.simhash import simhash_duplicates
from rolesift.llm.token_alignment import align_tokens
from rolesift.llm.toxicity import score_toxicity
from rolesift.llm.url_filter import UrlRule, judge_urls

__all__ = ["ORACLE", "QUERIES"]

RANKS = "byte_bpe_multi_50k.tiktoken"


@query(
    "op7_exact_dedup",
    r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)""",
)
def _exact_dedup(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("text_digest")


@query("op9_byte_bpe")
def _byte_bpe(spark, sf_dir):
    """No SQL: the ids come from the tiktoken library; tests hold them against encode_ordinary."""
    return round_trip(
        read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
URL_RULES = [
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
]


@query(
    "op2_url_filter",
    rf"""WITH u AS (SELECT page_id, coalesce({_HOST}, '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
      r AS (SELECT *, CASE
          WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
          WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
          WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
)
def _url_filter(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query("op10_sharding")
def _sharding(spark, sf_dir):
    """No SQL: it has no crc32; tests hold it against brute force."""
    return shard_documents(read(spark, sf_dir, "documents"), even_tree(24), even_tree(25))


def _sql_words(table: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return rf"SELECT {key}, regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


@query(
    "op4_decontamination",
    f"""WITH d AS ({_sql_words("documents", "doc_id")}), i AS ({_sql_words("benchmark", "item_id")}),
      iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[a : a + least(10, len(w)) - 1], ' ') AS win
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
      dw AS (SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') AS win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
      hit AS (SELECT doc_id, item_id, k, a FROM dw JOIN iw USING (k, win)),
      pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM hit) GROUP BY doc_id),
      its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids
        FROM hit GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def _decontamination(spark, sf_dir):
    judged = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged.drop("text_digest")


@query("op1_language_id")
def _language_id(spark, sf_dir):
    """No SQL: learned profiles; tests hold it against brute force and held-out accuracy."""
    return identify_languages(read(spark, sf_dir, "documents"))


@query("op8_quality")
def _quality(spark, sf_dir):
    """No SQL: a learned model; tests hold it against brute force and held-out accuracy."""
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_toxicity")
def _toxicity(spark, sf_dir):
    """No SQL: a learned model; tests hold it against brute force and held-out accuracy."""
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op6_jaccard_join",
    rf"""WITH RECURSIVE d AS (SELECT doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[a : a + least(5, len(w)) - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS a FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g)
        WHERE x.doc_id <> y.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE 100 * common >= 75 * (x.n + y.n - common)),
      r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
      m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, m.least) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id""",
)
def _jaccard_join(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query(
    "op5_line_dedup",
    """WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
      e AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
      l AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
      c AS (SELECT source, bare, count(DISTINCT doc_id) AS n FROM l WHERE bare <> '' GROUP BY source, bare),
      t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
      b AS (SELECT source, bare FROM c JOIN t USING (source) WHERE n >= 3 AND n > 0.005::DOUBLE * total),
      m AS (SELECT l.*, b.bare IS NOT NULL AS bad FROM l LEFT JOIN b USING (source, bare)),
      r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad) AS kept,
        count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped FROM m GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
      sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
)
def _line_dedup(spark, sf_dir):
    """The site of a document is its source."""
    cut = drop_boilerplate(read(spark, sf_dir, "documents"), "source", max_ratio=0.005)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cut.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query("op13_simhash")
def _simhash(spark, sf_dir):
    """No SQL: it has no seeded XXH64; tests hold it against brute force."""
    return simhash_duplicates(read(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def _conversation_repair(spark, sf_dir):
    """No SQL: a search for edits; tests hold it against dynamic programming over whole strings."""
    return repair_damaged(read(spark, sf_dir, "conversations"))


@query("op11_token_alignment")
def _token_alignment(spark, sf_dir):
    """No SQL: the ids come from two libraries; tests hold it against plain interval overlaps."""
    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(read(spark, sf_dir, "documents"), *files)
