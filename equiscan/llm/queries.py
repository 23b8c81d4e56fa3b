"""The registered queries of the operators, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscan.llm import (
    decontamination,
    jaccard_join,
    license_scan,
    merkle_manifest,
    packing,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    slack_packing,
    token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.read_located(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "_file", "_row")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shard_rows(docs, 8).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate_documents(table(spark, sf_dir, "documents"))


@query
def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op8_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op8_positional_decontamination"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_starts AS (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM item_starts),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_starts AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM docs, lengths WHERE len(w) >= m),
doc_windows AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM doc_starts),
found AS (SELECT d.doc_id, d.s, d.m, i.item_id FROM doc_windows d JOIN item_windows i ON d.m = i.m AND d.phrase = i.phrase),
places AS (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS place FROM found),
hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
named AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found),
item_lists AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM named GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN item_lists USING (doc_id)"""


@query
def op7_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("notices")


@query
def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))


@query
def op6_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: The key of the registered query; a deployment passes its own secret.
PII_KEY = b"key of the registered query"


@query
def op10_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return docs.select("doc_id", "text", *(F.col(f"pii_counts.{k}").alias(f"n_{k}") for k in pii.KINDS))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a number's decimals: a table of 256 remainders, then one step a digit.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(number: str) -> str:
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES["op11_conversation_trie"] = rf"""
WITH {_CRC_TABLE},
turns AS (
    SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
           len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'code': code, 'words': words}} ORDER BY turn NULLS FIRST, code) AS turns FROM turns GROUP BY conv_id),
kept AS (SELECT conv_id, turns, {_crc32("conv_id")} % 4 AS h FROM own, crc_table),
rebuilt AS (
    SELECT c.conv_id, coalesce(b.turns, [])[1 : c.h] || c.turns[c.h + 1 :] AS turns
    FROM kept c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt),
paths AS (
    SELECT conv_id, d, array_to_string(list_transform(turns[1 : d], lambda x: x.code), '') AS path, len(turns) = d AS ends,
           CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words
    FROM steps),
nodes AS (
    SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
    FROM paths GROUP BY path),
children AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
above AS (SELECT left(path, 64 * k) AS path, n_children, n_convs, words FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted)),
sums AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM above GROUP BY path)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN counted p ON c.depth > 0 AND p.path = left(c.path, 64 * (c.depth - 1))"""


@query
def op12_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = slack_packing.pack_with_little_slack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), merkle_manifest.without_line_breaks()).drop("proof")


#: Levels that the SQL of op13 spells out: up to 3 ** 11 documents a source.
_MERKLE_LEVELS = 11


def _merkle_sql() -> str:
    """Tree of every source level by level, then the tree of the sources; proofs join each level with its runs."""

    def part(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(part, ['doc_id', 'source', 'lang', 'n_chars', text]))})"

    out = [
        _CRC_TABLE,
        f"""rows AS (SELECT *, CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, crc_table)""",
        f"""leaves AS (SELECT coalesce('s' || source, 'n') AS tree, doc_id, {leaf("text")} AS node, {leaf("changed")} AS given FROM rows)""",
        """a0 AS (SELECT tree, doc_id, node, given, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i,
            count(*) OVER (PARTITION BY tree) AS n FROM leaves)""",
    ]

    def climb(name: str) -> None:
        """``name``0 holds (tree, node, i, n); a tree of one node stays as it is."""
        for k in range(_MERKLE_LEVELS):
            out.append(f"""{name}{k + 1} AS (
                SELECT tree, CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node, i // 3 AS i, (n + 2) // 3 AS n
                FROM {name}{k} GROUP BY tree, i // 3, n)""")

    def prove(name: str, first: str) -> str:
        """(tree, i0, proof, folded) after all levels, from rows ``first`` (tree, i0, i, proof, folded)."""
        out.append(first)
        for k in range(_MERKLE_LEVELS):
            out.append(f"""{name}p{k + 1} AS (
                SELECT p.tree, p.i0, p.i // 3 AS i, any_value(p.proof) || coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (WHERE s.i <> p.i AND s.n > 1), '') AS proof,
                       CASE WHEN any_value(s.n) = 1 THEN any_value(p.folded)
                            ELSE sha256(string_agg(CASE WHEN s.i = p.i THEN p.folded ELSE s.node END, '' ORDER BY s.i)) END AS folded
                FROM {name}p{k} p JOIN {name}{k} s ON s.tree = p.tree AND s.i // 3 = p.i // 3 GROUP BY p.tree, p.i0, p.i)""")
        return f"{name}p{_MERKLE_LEVELS}"

    climb("a")
    out.append(f"b0 AS (SELECT '' AS tree, tree AS source, node, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a{_MERKLE_LEVELS})")
    climb("b")
    lower = prove("a", "ap0 AS (SELECT tree, i AS i0, i, '' AS proof, given AS folded FROM a0)")
    # Above the subroots the path of all documents of a source is the same, but what is folded is not.
    upper = prove("b", f"bp0 AS (SELECT '' AS tree, l.tree || ':' || l.i0 AS i0, b0.i, l.proof, l.folded FROM {lower} l JOIN b0 ON b0.source = l.tree)")
    return f"""WITH {', '.join(out)}
        SELECT a0.doc_id, a0.node AS leaf, b0.node AS subroot, r.node AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.node AS verified
        FROM a0 JOIN b0 ON b0.source = a0.tree JOIN {upper} u ON u.i0 = a0.tree || ':' || a0.i CROSS JOIN b{_MERKLE_LEVELS} r"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()
