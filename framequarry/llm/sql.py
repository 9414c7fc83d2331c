"""DuckDB SQL for those training-data queries that SQL can express."""

OP1 = r"""
WITH words AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM words WHERE len(w) >= 20)
), ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS nth FROM windows
), hit AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM ranked WHERE nth > 1) GROUP BY doc_id
), flags AS (
  SELECT doc_id, p FROM (SELECT doc_id, unnest(gone) AS p FROM hit)
), each AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)
), kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t
  FROM each e ANTI JOIN flags f ON e.doc_id = f.doc_id AND e.p = f.p GROUP BY e.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

OP4 = r"""
WITH docs AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, k, v.n, item FROM windows v JOIN phrases p ON v.s = p.s AND v.n = p.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
  sha256(COALESCE(all_items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits ON docs.doc_id = hits.doc_id LEFT JOIN owners ON docs.doc_id = owners.doc_id
"""

#: CRC-32 of a list of bytes, by a table that the polynomial gives.
CRC_TABLE = "SELECT list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table"
CRC = "xor(list_reduce(list_concat([4294967295], list_transform({bytes}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
#: The UTF-8 bytes of a string, from its hexadecimal form.
BYTES = "list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: CAST(concat('0x', substr(hex(encode({text})), i, 2)) AS BIGINT))"


def _merkle(levels: int = 9) -> str:
    """Trees of at most 16^levels leaves a group: a level a pair of tables, a group that has one node being done."""
    digits = CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))")
    field = "COALESCE(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    out = [
        f"crc AS MATERIALIZED ({CRC_TABLE})",
        f"""leaves AS MATERIALIZED (SELECT doc_id, COALESCE(concat('=', source), '') AS grp, {leaf("text")} AS leaf, {leaf("changed")} AS tampered
  FROM (SELECT *, CASE WHEN {digits} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents, crc))""",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves)",
        "na0 AS MATERIALIZED (SELECT grp, idx, n, leaf AS digest FROM a0)",
    ]
    for tree in "ab":
        if tree == "b":
            out.append(f"nb0 AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n, digest, grp AS member FROM na{levels})")
        for k in range(levels):
            # a group that is done passes on; else 16 nodes become one
            out.append(f"""n{tree}{k + 1} AS MATERIALIZED (SELECT grp, 0 AS idx, 1 AS n, digest FROM n{tree}{k} WHERE n = 1 UNION ALL
  SELECT grp, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM n{tree}{k} WHERE n > 1 GROUP BY grp, idx // 16)""")

    def joined(tree: str, grp: str, idx: str) -> tuple[str, str]:
        """The siblings of each level beside node idx of level 0, as columns l and r, by joins."""
        columns, joins = [], []
        for k in range(levels):
            at = f"({idx} // {16**k})"
            columns.append(f"{tree}{k}.l AS {tree}l{k}, {tree}{k}.r AS {tree}r{k}")
            joins.append(f"LEFT JOIN s{tree}{k} {tree}{k} ON {tree}{k}.grp = {grp} AND {tree}{k}.idx = {at}")
        return ", ".join(columns), " ".join(joins)

    for tree in "ab":
        for k in range(levels):
            run = "PARTITION BY grp, idx // 16 ORDER BY idx ROWS BETWEEN"
            out.append(f"""s{tree}{k} AS MATERIALIZED (SELECT grp, idx, COALESCE(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  COALESCE(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{tree}{k} WHERE n > 1)""")
    (ac, aj), (bc, bj) = joined("a", "x.grp", "x.idx"), joined("b", "''", "t.idx")
    sides = [(f"{tree}l{k}", f"{tree}r{k}") for tree in "ab" for k in range(levels)]
    out.append(f"tops AS MATERIALIZED (SELECT t.member, t.digest AS subroot, {bc} FROM nb0 t {bj})")
    out.append(f"paths AS MATERIALIZED (SELECT x.doc_id, x.leaf, x.tampered, t.*, {ac} FROM a0 x JOIN tops t ON t.member = x.grp {aj})")
    out.append("f0 AS (SELECT *, tampered AS d0 FROM paths)")
    for k, (left, right) in enumerate(sides):
        out.append(f"f{k + 1} AS (SELECT * EXCLUDE (d{k}), CASE WHEN {left} IS NULL THEN d{k} ELSE sha256(concat({left}, d{k}, {right})) END AS d{k + 1} FROM f{k})")
    proof = ", ".join(f"{left}, {right}" for left, right in sides)
    return f"""WITH {", ".join(out)}
SELECT doc_id, leaf, subroot, root, sha256(concat({proof})) AS proof_sha256, d{len(sides)} AS folded_root, d{len(sides)} = root AS verified
FROM f{len(sides)}, (SELECT digest AS root FROM nb{levels})"""


#: Words, single or in pairs; a bucket is a feature's CRC-32; benchmark and documents are counted alike.
OP13 = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}), texts AS MATERIALIZED (
  SELECT kind, id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)
), found AS MATERIALIZED (
  SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS feature FROM texts
), hashed AS MATERIALIZED (
  SELECT feature, {CRC.format(bytes=BYTES.format(text="feature"))} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM found), crc
), counted AS (SELECT kind, bucket, count(*) AS many FROM found JOIN hashed USING (feature) GROUP BY ALL),
sums AS (SELECT COALESCE(sum(many) FILTER (kind = 'd'), 0) AS all_s, COALESCE(sum(many) FILTER (kind = 'b'), 0) AS all_t FROM counted),
gains AS (
  SELECT s.bucket, floor(1000 * ln(CAST((COALESCE(t.many, 0) + 1) AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s.many + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS gain
  FROM (SELECT * FROM counted WHERE kind = 'd') s LEFT JOIN (SELECT * FROM counted WHERE kind = 'b') t USING (bucket), sums
), weights AS (
  SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM found JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scores AS (
  SELECT id AS doc_id, len(w) AS n_words, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight,
    COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('7:', id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (id) WHERE kind = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""


#: Character classes as patterns, in order; symbols are what is left of ASCII.
CLASSES = ("[aeiou]", "[bcdfghjklmnpqrstvwxyz]", "[A-Z]", "[0-9]", " ", "[\\x09-\\x0D]", "[.]", "[,;:''\"()-]", "[!?]", None, "[^\\x00-\\x7F]")
_TEXT = "COALESCE(text, '')"


def _matches(pattern: str) -> str:
    return f"length({_TEXT}) - length(regexp_replace({_TEXT}, '{pattern}', '', 'g'))"


def _half_entropies(p: str, q: str) -> str:
    """A place's part of the Jensen-Shannon divergence of two shares."""
    of = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END)"
    return f"({of(p)} + {of(q)}) / 2 - {of(f'(({p} + {q}) / 2)')}"


def _class_distance(mine: str, theirs: str) -> str:
    """Of tables with c0 to c10."""
    share = lambda t, k: f"({t}.c{k}::DOUBLE / greatest(1, {' + '.join(f'{t}.c{j}' for j in range(11))}))"
    return f"sqrt(greatest(0.0, {' + '.join(_half_entropies(share(mine, k), share(theirs, k)) for k in range(11))}))"


def _rules() -> str:
    columns = ", ".join(f"{_matches(p)} AS c{k}" for k, p in enumerate(CLASSES) if p)
    others = " + ".join(f"c{k}" for k, p in enumerate(CLASSES) if p)
    sums = ", ".join(f"sum(c{k}) AS c{k}" for k in range(11))
    p, q = "(COALESCE(h.many, 0)::DOUBLE / n_words)", "(r.many::DOUBLE / r.whole)"
    return rf"""
WITH d0 AS MATERIALIZED (
  SELECT doc_id, lang, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace({_TEXT}, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_matches("[#*$%&|<>]")} AS n_symbols,
    list_filter(string_split({_TEXT}, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, length({_TEXT}) AS size, {columns} FROM documents
), t AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS many FROM (SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d0))),
again AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS place FROM t WHERE many > 1) GROUP BY doc_id),
d AS MATERIALIZED (
  SELECT d0.*, size - ({others}) AS c9, len(w) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines, COALESCE(again.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * COALESCE(again.n, 0) > 50 * len(w) AS base_failed
  FROM d0 LEFT JOIN again USING (doc_id)
), usable AS MATERIALIZED (SELECT * FROM d WHERE NOT base_failed AND lang IS NOT NULL),
known AS MATERIALIZED (SELECT lang FROM usable GROUP BY lang HAVING count(*) * 1000 >= (SELECT count(*) FROM usable)),
rough AS MATERIALIZED (SELECT lang, {sums} FROM usable SEMI JOIN known USING (lang) GROUP BY lang),
ranked AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY bin) - 1 AS before, count(*) OVER (PARTITION BY lang) AS docs FROM (SELECT u.*, floor({_class_distance("u", "r")} * 1000) AS bin FROM usable u JOIN rough r ON u.lang = r.lang)),
refs AS MATERIALIZED (SELECT lang, {sums} FROM ranked WHERE 2 * before < docs GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, word, count(*) AS many FROM (SELECT lang, unnest(w) AS word FROM usable SEMI JOIN known USING (lang)) GROUP BY ALL),
whole AS (SELECT lang, sum(many) AS whole FROM counts GROUP BY lang),
top AS MATERIALIZED (SELECT lang, word, many FROM counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY many DESC, encode(word)) <= 64),
words AS MATERIALIZED (SELECT lang, word, many, whole FROM top JOIN whole USING (lang) UNION ALL SELECT lang, NULL, any_value(whole) - sum(many), any_value(whole) FROM top JOIN whole USING (lang) GROUP BY lang),
sound AS MATERIALIZED (SELECT * FROM d WHERE NOT base_failed),
held AS MATERIALIZED (SELECT doc_id, word, count(*) AS many FROM (SELECT doc_id, unnest(w) AS word FROM sound) GROUP BY ALL),
mine AS MATERIALIZED (SELECT h.doc_id, t.lang, h.word, h.many FROM held h JOIN top t USING (word)),
full_mine AS (SELECT doc_id, lang, word, many FROM mine UNION ALL SELECT s.doc_id, k.lang, NULL, s.n_words - COALESCE(m.n, 0) FROM sound s CROSS JOIN known k LEFT JOIN (SELECT doc_id, lang, sum(many) AS n FROM mine GROUP BY ALL) m ON m.doc_id = s.doc_id AND m.lang = k.lang),
wd AS (SELECT s.doc_id, r.lang, sqrt(greatest(0.0, sum({_half_entropies(p, q)}))) AS wd FROM sound s CROSS JOIN words r LEFT JOIN full_mine h ON h.doc_id = s.doc_id AND h.lang = r.lang AND h.word IS NOT DISTINCT FROM r.word GROUP BY ALL),
far AS (SELECT s.doc_id, wd.lang, wd, {_class_distance("s", "r")} AS cd FROM sound s JOIN wd USING (doc_id) JOIN refs r ON r.lang = wd.lang),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cd + wd, lang) = 1)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT COALESCE((size >= 800 AND cd > 0.16) OR wd > 0.30 + 1 / sqrt(n_words), false) AS kept, best.lang AS ref_lang, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM d LEFT JOIN best ON best.doc_id = d.doc_id
"""


def llm_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op4_decontamination": OP4, "op11_merkle_manifest": _merkle(), "op12_quality_rules": _rules(), "op13_importance_resampling": OP13}
