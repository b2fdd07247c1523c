"""DuckDB texts that give what the queries of this package give, where SQL can say it."""

from .quality_rules import BOILERPLATE, PROSE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _without(text: str, chars: str) -> str:
    return f"translate({text}, '{chars}', '')"


OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b, sha1(encode(coalesce(html, ''))) h FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT payload_bytes, list_aggregate(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN first <> page_id THEN first END refers_to FROM g
"""

OP3 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(8, len(w)) k, array_to_string(w[i:i + 7], ' ') g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT dg.doc_id, dg.i, dg.k, bg.item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g),
per AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + k)))))::BIGINT n_hit, count(DISTINCT item_id) n_items,
  array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
FROM dw LEFT JOIN per ON dw.doc_id = per.doc_id
"""

_NOISE = "#*$%&|<>!?=~^_"
_PHRASES = " + ".join(f"contains(lower(x), '{p}')::INTEGER" for p in BOILERPLATE)
_PROSE = PROSE.replace("'", "''")
OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, {WORDS} w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines FROM d),
win AS (SELECT doc_id, i, w[i:i+4] s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(i - before, 5)))::BIGINT n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) before FROM rep) GROUP BY doc_id),
good AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{_PROSE}')
    AND (length(x) - length({_without('x', _NOISE)})) * 100 <= 10 * length(x)
    AND (length(x) - length(replace(x, ' | ', '')) + length(x) - length(replace(x, ' > ', '')) + length(x) - length(replace(x, ' » ', '')) + length(x) - length(replace(x, ' · ', ''))) <= 6
    AND ({_PHRASES}) * 80 < length(x)) g FROM l),
m AS (SELECT good.doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, (length(t) - length({_without('t', '#*$%&|<>')}))::BIGINT n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words,
    coalesce(length(array_to_string(lines, '')), 0)::BIGINT line_chars, coalesce(length(array_to_string(g, '')), 0)::BIGINT good_chars
  FROM good LEFT JOIN cov ON good.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (line_chars - good_chars) * 100 <= 50 * line_chars kept, line_chars - good_chars lost_chars FROM m
"""

#: CRC-32 (reflected 0xEDB88320) byte by byte, its table made by eight halving steps.
OP9 = """
WITH RECURSIVE bits AS (SELECT i, i::BIGINT v, 0 k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) t FROM bits WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 size, text FROM documents),
crc AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])))::BIGINT text_crc32 FROM d, tab),
c AS (SELECT doc_id, size, text_crc32, (sum(size) OVER (ORDER BY doc_id))::BIGINT - size below, (sum(size) OVER ())::BIGINT total FROM crc),
s AS (SELECT *, (16 * below // total)::INTEGER shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 slot, NULL::INTEGER grown_shard FROM s
"""

ORACLES = {"op1_warc": OP1, "op3_decontamination": OP3, "op7_quality_rules": OP7, "op9_sharding": OP9}
