"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from deskspark.llm.chat_windows import CLOSE, ESCAPES, OPEN, TOKEN, WindowBudget
from deskspark.llm.conversation_repair import (
    ACCEPTED,
    BLANKS,
    DELETE,
    INSERT,
    NEXT,
    NOTHING,
    REROLE,
    ROLES,
    TRUNCATED,
)
from deskspark.llm.divergence_rules import CLASSES, COMMON_WORDS, DivergenceRules
from deskspark.llm.line_dedup import NULL_ID, LineRule


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op2() -> str:
    return """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """


def _op3() -> str:
    b = WindowBudget()

    def escaped(sql: str) -> str:
        for old, new in ESCAPES:
            sql = f"replace({sql}, {_quoted(old)}, {_quoted(new)})"
        return sql

    control = _quoted("\\### Assistant: </turn> ok")
    close = _quoted(CLOSE[:-1]) + " || chr(10)"
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', {control} UNION ALL SELECT -7, 1, 'assistant', {control}),
    shown AS (
        SELECT *, '{OPEN}' || replace({escaped('role')}, chr(10), '\\n') || chr(10) || {escaped('text')} || {close} AS shown
        FROM turns),
    placed AS (
        SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(tokens) OVER (
            PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT *, len(regexp_extract_all(shown, {_quoted(TOKEN)})) AS tokens FROM shown)
        WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    cells AS (
        SELECT *, place = 0 AND role = 'system' AS lead, (before + tokens - 1) // {b.fresh} AS cell,
            before // {b.fresh} <> (before + tokens - 1) // {b.fresh} AS across FROM placed),
    filled AS (
        SELECT conv_id, cell, sum(tokens) AS filled FROM cells WHERE NOT lead AND NOT across GROUP BY ALL),
    body AS (
        SELECT c.*, 2 * c.cell + CASE WHEN NOT across OR coalesce(filled, 0) + tokens <= {b.fresh} THEN 1 ELSE 0 END AS part
        FROM cells c LEFT JOIN filled f ON c.conv_id = f.conv_id AND c.cell = f.cell WHERE NOT lead),
    starts AS (
        SELECT conv_id, part, min(place) AS first_place, min(before) AS from_tokens FROM body GROUP BY ALL),
    lines AS (
        SELECT conv_id, shown FROM body
        UNION ALL SELECT conv_id, shown FROM cells WHERE lead
        UNION ALL SELECT s.conv_id, l.shown FROM starts s JOIN cells l ON l.lead AND l.conv_id = s.conv_id
            WHERE s.first_place > 1
        UNION ALL SELECT s.conv_id, h.shown FROM starts s JOIN cells h ON h.conv_id = s.conv_id AND NOT h.lead
            AND h.place < s.first_place AND h.place >= s.first_place - {b.history_turns}
            AND s.from_tokens - h.before <= {b.history}),
    sizes AS (SELECT conv_id, sum(length(shown)) AS formatted_chars FROM lines GROUP BY ALL),
    whole AS (
        SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
        FROM turns GROUP BY ALL)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
        formatted_chars::BIGINT AS formatted_chars
    FROM whole JOIN sizes USING (conv_id)
    """


def _op6() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return f"""
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages)
    SELECT page_id, strlen(body) AS payload_bytes,
        list_aggregate(list_transform(range(32), lambda i: substr({letters},
            (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)),
            'string_agg', '') AS payload_digest,
        CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
        nullif(max(page_id) OVER same, page_id) AS refers_to
    FROM payloads WINDOW same AS (PARTITION BY body)
    """


def _op9(shards: int = 40, seed: int = 11) -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    entry = "i"
    for _ in range(8):
        entry = f"list_transform({entry}, lambda c: {step})"
    return f"""
    WITH bits AS (SELECT {entry.replace('(i,', '(list_transform(range(256), lambda x: x::BIGINT),')} AS entries),
    sized AS (
        SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS text,
            md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS shuffle FROM documents),
    bytes AS (
        SELECT DISTINCT text, list_transform(regexp_extract_all(hex(encode(text)), '..'),
            lambda x: ('0x' || x)::BIGINT) AS bytes FROM sized),
    checked AS (
        SELECT text, xor(list_reduce(bytes, lambda c, b:
            xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
        FROM bytes, bits),
    ranked AS (
        SELECT doc_id, source, size, text_crc32, shuffle,
            (2 * (row_number() OVER o - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS part
        FROM sized JOIN checked USING (text)
        WINDOW o AS (PARTITION BY source ORDER BY shuffle, doc_id, text_crc32, size)),
    placed AS (
        SELECT *, row_number() OVER (ORDER BY part, source NULLS FIRST, shuffle, doc_id, text_crc32, size) - 1 AS position,
            count(*) OVER () AS n FROM ranked)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
        (position * {shards} // n)::INT AS shard,
        position - ((position * {shards} // n) * n + {shards - 1}) // {shards} AS slot, NULL::INT AS grown_shard
    FROM placed
    """


def _op10() -> str:
    rules = DivergenceRules()
    n = len(CLASSES) + 2
    listed = sorted({f for ws in COMMON_WORDS.values() for w in ws for f in (w, w.capitalize(), w.upper())})
    stripped, columns = "text", []
    for _, pattern in CLASSES:
        stripped = f"regexp_replace({stripped}, {_quoted(pattern)}, '', 'g')"
        columns.append(f"length({stripped})")
    taken = [f"{a} - {b}" for a, b in zip(columns[:-1], columns[1:])]
    classes = f"[length(text) - ink, length(text) - {columns[0]} - (length(text) - ink), {', '.join(taken)}, {columns[-1]}]"
    common = " ".join(
        f"WHEN {_quoted(lang)} THEN ["
        + ", ".join(f"len(list_filter(found, lambda w: w = {_quoted(w)}))" for w in words)
        + "]"
        for lang, words in COMMON_WORDS.items()
    )

    def distance(counts: str, total: str, reference: str, whole: str, size: int) -> str:
        terms = []
        for i in range(1, size + 1):
            p, q = f"({counts}[{i}]::DOUBLE / {total})", f"({reference}[{i}]::DOUBLE / {whole})"
            m = f"(({p} + {q}) / 2)"
            terms.append(
                f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + "
                f"CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2"
            )
        return f"sqrt(greatest(0, {' + '.join(terms)}))"

    k = len(next(iter(COMMON_WORDS.values())))
    class_sums = ", ".join(f"sum(classes[{i}])" for i in range(1, n + 1))
    common_sums = ", ".join(f"sum(common[{i}])" for i in range(1, k + 2))
    return f"""
    WITH cut AS (
        SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    sized AS (SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS ink,
            list_transform(list_filter(words, lambda w: w IN ({', '.join(map(_quoted, listed))})),
                lambda w: lower(w)) AS found FROM cut),
    wins AS (
        SELECT id, unnest(range(1, n_words - 1)) AS i, n_words FROM sized WHERE n_words > 2),
    named AS (
        SELECT w.id, w.i, s.words[w.i] || ' ' || s.words[w.i + 1] || ' ' || s.words[w.i + 2] AS win
        FROM wins w JOIN sized s ON w.id = s.id),
    again AS (
        SELECT id, i FROM named QUALIFY count(*) OVER (PARTITION BY id, win) > 1),
    repeats AS (
        SELECT id, count(DISTINCT spot) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS spot FROM again) GROUP BY id),
    lines AS (
        SELECT id, count(*) - count(DISTINCT line) AS n FROM (
            SELECT id, unnest(string_split(text, chr(10))) AS line FROM cut)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY id),
    counted AS (
        SELECT s.*, {classes} AS classes, CASE lang {common} END AS hits,
            coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_dup_lines,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
        FROM sized s LEFT JOIN repeats r ON s.id = r.id LEFT JOIN lines l ON s.id = l.id),
    both_ AS (SELECT *, list_append(hits, n_words - list_sum(hits)) AS common FROM counted),
    refs AS (
        SELECT lang, [{class_sums}] AS ref_classes, [{common_sums}] AS ref_common, sum(n_words) AS ref_words
        FROM both_ WHERE hits IS NOT NULL GROUP BY lang),
    measured AS (
        SELECT b.*,
            CASE WHEN list_sum(classes) >= {rules.min_class_chars} AND list_sum(ref_classes) > 0 THEN
                {distance('classes', 'list_sum(classes)', 'ref_classes', 'list_sum(ref_classes)', n)} END AS class_distance,
            CASE WHEN n_words >= {rules.min_common_words} AND ref_words > 0 THEN
                {distance('common', 'n_words', 'ref_common', 'ref_words', k + 1)} END AS common_distance,
            n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed
        FROM both_ b LEFT JOIN refs r ON b.lang = r.lang)
    SELECT doc_id, n_words, ink AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed
        AND coalesce(class_distance <= {rules.class_limit[0]} + {rules.class_limit[1]} / sqrt(n_words), true)
        AND coalesce(common_distance <= {rules.common_limit[0]} + {rules.common_limit[1]} / sqrt(n_words), true) AS kept
    FROM measured
    """


def _op11() -> str:
    rule = LineRule()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
    WITH docs AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, {NULL_ID}) AS doc,
            string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (
        SELECT id, doc, place, lines[place] AS line, translate(trim(lines[place], {blanks}), '{upper}', '{lower}') AS key
        FROM (SELECT id, doc, lines, unnest(range(1, len(lines) + 1)) AS place FROM docs)),
    shared AS (
        SELECT key, max(doc) AS keep FROM lines WHERE length(key) >= {rule.min_chars}
        GROUP BY key HAVING count(DISTINCT doc) >= {rule.min_docs}),
    left_ AS (
        SELECT id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS kept
        FROM lines LEFT JOIN shared USING (key) WHERE keep IS NULL OR keep = doc GROUP BY id)
    SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN left_ USING (id)
    """


def _op12() -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    entry = "i"
    for _ in range(8):
        entry = f"list_transform({entry}, lambda c: {step})"
    # Every way through one row: up to two insertions, then an edit; and up to two insertions at the end.
    ways, ends = [], []
    for state in range(len(NEXT)):
        at, before, cost = state, "", 0
        for _ in range(3):
            named = NEXT[at]
            ways.append(f"({state}, '*', '{before}D', {at}, {cost + DELETE}, 0)")
            ways += [f"({state}, '{k}', '{before}K', {v}, {cost}, 1)" for k, v in named.items()]
            after = next(v for k, v in named.items() if k in ROLES)
            ways.append(f"({state}, '+', '{before}R', {after}, {cost + REROLE}, 1)")
            if at in ACCEPTED:
                ends.append(f"({state}, '{before}', {cost})")
            at, before, cost = after, before + "I", cost + INSERT
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
    WITH RECURSIVE bits AS (SELECT {entry.replace('(i,', '(list_transform(range(256), lambda x: x::BIGINT),')} AS entries),
    crc AS (
        SELECT key, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(key)), '..'), lambda x: ('0x' || x)::BIGINT),
            lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
        FROM (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), bits),
    hurt AS (
        SELECT conv_id, turn, kind, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
        FROM conversations JOIN crc ON key = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')),
    rows_ AS (
        SELECT conv_id, turn, role, text, trim(text, {blanks}) AS ink,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
        FROM (SELECT conv_id, turn, role, text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hurt)),
    faults AS (
        SELECT *, role[1] AS initial, CASE WHEN ink = '' THEN 'b'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
            WHEN ink[-1] NOT IN ('.', '!', '?') THEN 't' ELSE 's' END AS fault FROM rows_),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
            count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM faults) GROUP BY conv_id),
    ways(before, initial, edits, after, cost, stays) AS (VALUES {', '.join(ways)}),
    ends(state, edits, cost) AS (VALUES {', '.join(ends)}),
    paths AS (
        SELECT conv_id, 0 AS place, {NOTHING} AS state, {{'cost': 0::BIGINT, 'edits': ''}} AS best FROM counts
        UNION ALL
        SELECT f.conv_id, f.place, w.after, min({{'cost': p.best.cost + w.cost
            + CASE WHEN w.stays = 1 AND f.fault = 't' THEN {TRUNCATED} ELSE 0 END, 'edits': p.best.edits || w.edits}})
        FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place + 1
            JOIN ways w ON w.before = p.state AND (w.stays = 0 OR f.fault IN ('t', 's')) AND w.initial IN ('*', '+', f.initial)
        GROUP BY f.conv_id, f.place, w.after),
    found AS (
        SELECT c.conv_id, min({{'cost': p.best.cost + e.cost, 'edits': p.best.edits || e.edits}}) AS best
        FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.place = c.n JOIN ends e USING (state)
        GROUP BY c.conv_id),
    letters AS (
        SELECT conv_id, best.edits AS audit, unnest(range(1, length(best.edits) + 1)) AS spot FROM found),
    applied AS (
        SELECT conv_id, spot, audit[spot] AS edit,
            length(regexp_replace(audit[1:spot], 'I', '', 'g')) AS place FROM letters),
    roles AS (
        SELECT a.*, f.role, f.text, sum(CASE WHEN edit = 'D' OR edit = 'K' AND f.initial = 's' THEN 0 ELSE 1 END)
                OVER (PARTITION BY a.conv_id ORDER BY spot) AS said
        FROM applied a LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.place = a.place),
    lines AS (
        SELECT conv_id, spot, CASE WHEN edit = 'K' THEN role WHEN said % 2 = 1 THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM roles WHERE edit <> 'D'),
    whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY spot) AS lines FROM lines GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
        coalesce(best.edits, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
    """


ORACLES: dict[str, str] = {
    "op2_quotient_dedup": _op2(),
    "op3_chat_windows": _op3(),
    "op6_arc_to_warc": _op6(),
    "op9_interleaved_shards": _op9(),
    "op10_divergence_rules": _op10(),
    "op11_bloom_lines": _op11(),
    "op12_ida_repair": _op12(),
}
