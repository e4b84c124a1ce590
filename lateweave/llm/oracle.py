"""The same in SQL, where SQL can express it over the whole tables."""

from __future__ import annotations

import string

_NORMALISED = (f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')")

ORACLE = {
    "op6_exact_duplicates": f"""
        WITH d AS (SELECT doc_id, {_NORMALISED} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM d""",
}

# Words of every text, the digest of the window at every place, and the places that a hit covers.
ORACLE["op11_repeated_passages"] = r"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    win AS (SELECT r, doc_id, unnest(range(1, len(words) - 48)) AS place,
                   unnest(list_transform(range(1, len(words) - 48),
                                         lambda i: md5(array_to_string(words[i:i + 49], ' ')))) AS body
            FROM w WHERE len(words) >= 50),
    hits AS (SELECT r, place FROM (SELECT r, doc_id, place, min(doc_id) OVER (PARTITION BY body) AS low FROM win)
             WHERE low < doc_id),
    gone AS (SELECT DISTINCT r, place + k AS p FROM hits, unnest(range(50)) AS t(k)),
    places AS (SELECT r, generate_subscripts(words, 1) AS p, unnest(words) AS word FROM w),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
             FROM places ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(body, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (r)"""

# The CRC-32 of a decimal number, by a table that a rule makes (fixed value: the reversed polynomial).
_CRC = """
    crc_table AS (SELECT list(v ORDER BY i) AS v FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
                              CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
        FROM range(256) t(i)))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''),
                                             lambda c: ascii(c)::BIGINT)),
                lambda h, b: xor(h >> 8, crc_table.v[(xor(h, b) & 255) + 1])), 4294967295)"""


# A conversation is the row of its turns' digests, a node the beginning of such a row.
ORACLE["op12_prefix_trie"] = f"""
    WITH {_CRC},
    turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
                     md5(role) || md5(text) AS body, octet_length(encode(text)) AS bytes
              FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                    WHERE conv_id IS NOT NULL)),
    conv AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h
             FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), crc_table),
    built AS (SELECT c.conv_id, 0 AS part, t.pos, t.body, t.bytes FROM conv c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
              UNION ALL
              SELECT c.conv_id, 1, t.pos, t.body, t.bytes FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
    whole AS (SELECT c.conv_id, coalesce(string_agg(body, '' ORDER BY part, pos), '') AS body,
                     coalesce(list(bytes ORDER BY part, pos) FILTER (bytes IS NOT NULL), []) AS bytes, count(body) AS n
              FROM conv c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id),
    member AS (SELECT conv_id, n, d, md5(body[1:64 * d]) AS path, CASE WHEN d > 0 THEN md5(body[1:64 * (d - 1)]) END AS above,
                      CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS bytes
               FROM (SELECT *, unnest(range(n + 1)) AS d FROM whole)),
    node AS (SELECT d, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
                    any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                                                        FILTER (n = d), '') AS ends
             FROM member GROUP BY d, path),
    child AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
    tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, path)),
    sums AS (SELECT m.d, m.path, sum((t.n_children = 0)::BIGINT) AS n_leaves, sum((t.n_convs - 1) * t.bytes) AS saved
             FROM tree t JOIN member m ON m.conv_id = t.conv_id AND m.d <= t.d GROUP BY m.d, m.path)
    SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves::BIGINT AS n_leaves,
           s.saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
    FROM tree t JOIN sums s USING (d, path) LEFT JOIN tree p ON p.d = t.d - 1 AND p.path = t.above"""
