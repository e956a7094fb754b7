"""Line dedup, conversation repair and token alignment against brute force, with odd rows."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deskspark.llm import conversation_repair as cr
from deskspark.llm import line_dedup

DOCS = "doc_id bigint, text string, line string, n int, doc int, suspects string"
BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def line_texts():
    rng = random.Random(3)
    shared = [("é" if i % 2 else "S") + f"hared line number {i} " + "wörd " * (4 + i % 6) for i in range(12)]
    out = [None, "", "\n", "x" * 300, ("y" * 39 + "\n") * 8, "\n".join([shared[0]] * 9)]
    for _ in range(60):
        lines = [" ".join(str(rng.random()) for _ in range(3)) for _ in range(rng.randrange(0, 4))]
        for s in rng.sample(shared, rng.randrange(0, 4)):
            lines.append(rng.choice([s, s.upper() if s[0] == "S" else s, " \t" + s + "\r", s + "!"]))
        rng.shuffle(lines)
        out.append("\n".join(lines))
    return out + [("y" * 40 + "\n") * 3] * 7


def expected_lines(pairs, rule):
    holders = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= rule.min_chars:
                holders[key_of(line)].add(-(1 << 63) if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= rule.min_docs}
    out = Counter()
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key_of(x), i if i is not None else -(1 << 63)) == (i if i is not None else -(1 << 63))]
        out[i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("rule", [line_dedup.LineRule(), line_dedup.LineRule(min_chars=1, min_docs=2)])
def test_line_dedup(spark, rule):
    rows = [(i, t, "l", 1, 2, "s") for i, t in enumerate(line_texts())]
    rows += [(None, rows[8][1], "l", 1, 2, "s"), rows[9], (7, rows[10][1], "l", 1, 2, "s")]
    table = spark.createDataFrame(rows, DOCS).repartition(5)
    want = expected_lines([r[:2] for r in rows], rule)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(table, rule).collect())
    assert got == Counter({k[:4]: 0 for k in want}) + sum((Counter({k[:4]: n}) for k, n in want.items()), Counter())
    texts = Counter((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(table, rule).collect())
    assert texts == sum((Counter({(k[0], k[4]): n}) for k, n in want.items()), Counter())
    assert line_dedup.line_report(table.limit(0), rule).count() == 0


def test_crowded_filters_change_nothing(spark):
    rng = random.Random(1)
    lines = [f"{rng.random()} {rng.random()} {rng.random()}" for _ in range(30_000)]
    rows = [(i, "\n".join(lines[i * 150 : i * 150 + 155])) for i in range(200)] + [(900 + i, lines[5]) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {k[:4] for k in expected_lines(rows, line_dedup.LineRule())}
    for bits in (16, 20):
        assert {tuple(r) for r in line_dedup.line_report(table, bits=bits).collect()} == want


def test_filter_blocks_pack_without_loss():
    rng = np.random.default_rng(1)
    for n in (0, 1, 100, 4095, 4096, 40_000):
        flt = line_dedup.Bloom(16)
        flt.add(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (line_dedup._unpacked(line_dedup._packed(flt.data)) == flt.data).all()


def dearest_first(initials, faults):
    """Uniform-cost search over all edits; returns (cost, audit)."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(faults) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for r, to in follow[state].items():
            if r != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, to))
        if i < len(faults):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if faults[i] in "ts":
                extra = faults[i] == "t"
                if initials[i] in follow[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, follow[state][initials[i]]))
                for r, to in follow[state].items():
                    if r != "s":
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, to))


def test_search_finds_the_cheapest_and_least_edits():
    for n in range(5):
        for initials in itertools.product("sua-", repeat=n):
            for faults in itertools.product("bts", repeat=n):
                got = cr.Conversation("".join(initials), "".join(faults)).cheapest()
                assert got == dearest_first("".join(initials), "".join(faults)), (initials, faults)
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(5, 40)
        initials, faults = "".join(rng.choices("suuaa-", k=n)), "".join(rng.choices("bdtsss", k=n))
        assert cr.Conversation(initials, faults).cheapest() == dearest_first(initials, faults)


def test_search_of_a_long_conversation():
    rng = random.Random(6)
    n = 5000
    initials, faults = "".join(rng.choices("sua", k=n)), "".join(rng.choices("bdtsss", k=n))
    cost, audit = cr.Conversation(initials, faults).cheapest()
    assert cost == dearest_first(initials, faults)[0]
    assert sum(audit.count(c) for c in "DKR") == n


def conversations():
    rng = random.Random(8)
    said = ["Hi.", "What?", "no end", "", " \n", "Yes!", "Hi.", "a. b. c", None]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(said)))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}" + ".!?x"[t % 4]) for t in range(1500)]
    rows += [(None, None, "user", "x."), (None, 3, "assistant", "y."), (501, None, "user", "q.")]
    rows += [(502, t, "user", "s") for t in range(3000) if zlib.crc32(f"502:{t}".encode()) % 20 == 0]
    return rows + rows[:3]


def expected_repairs(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        kept = by[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(t, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = "", set()
        for _, role, text in kept:
            ink = text.strip(BLANKS)
            faults += "b" if not ink else "d" if (role, text) in seen else "s" if ink[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        cost, audit = dearest_first([x if x and x in "sua" else "-" for x in initials], faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in kept} - {None}
        state, lines, i = 0, [], 0
        for edit in audit:
            after = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            if edit == "I":
                role, text = after, ""
            else:
                _, role, text = kept[i]
                i += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = after
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(f) for f in "bdt"], illegal, cost, audit, sha("\n".join(lines)),
        )
    return out


def test_conversation_repair(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, gone int, fault string")
    got = {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in cr.repair_damaged(table.repartition(6)).collect()
    }
    assert got == expected_repairs(rows)
    assert cr.repair_damaged(table.limit(0)).count() == 0


def test_repaired_turns():
    assert cr.repaired_turns([("user", "a", "t"), ("user", "b.", "s")]) == [("user", "a"), ("assistant", "b.")]
    assert cr.repaired_turns([("assistant", "a.", "s"), ("user", "b.", "s")]) == [
        ("user", ""), ("assistant", "a."), ("user", "b."), ("assistant", "")
    ]


tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")


def aligned_texts():
    rng = random.Random(9)
    words = ["the", "retitioning", "éç", "日本", "a\nb", "x's", "12,000", "<|endoftext|>", "<s>", "\t", "", " ", "é", "😀", "<0x41>"]
    out = [None, "", " ", "  a", "a ", "▁", "a ▁b", "one", "\x1c x", "a \x1c b", "x" * 700, "日本語" * 90, " " * 80, "\x00 y", "a  b"]
    for _ in range(50):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))))
    return out + out[20:26]


def expected_alignment(texts):
    a_tok = tokenizers.Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = {c: b for b, c in enumerate_byte_letters()}
    all_links, docs = [], []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a = a_tok.encode(" " + t, add_special_tokens=False).ids
        b = b_tok.encode(t)
        a_raw = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = []
        for i in b:
            p = b_tok.id_to_piece(i)
            b_raw.append(bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode())
        want = (" " + t).encode()
        if b"".join(a_raw) != want or b"".join(b_raw) != want:
            docs.append(None)
            continue
        a_ends, b_ends = list(itertools.accumulate(map(len, a_raw))), list(itertools.accumulate(map(len, b_raw)))
        common = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for c in common:
            k, m = a_ends.index(c, i) + 1, b_ends.index(c, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        found = [(x, y) for g in groups for x in g[0] for y in g[1]]
        docs.append((len(a), len(b), groups, found))
        all_links.append(set(found))
    count = Counter(p for s in all_links for p in s)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, found = d
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        hits = sum(count[p] == best[p[0]] for p in found)
        out.append((n_a, n_b, len(groups), len(found), hits, sum(count[p] for p in found), sha(text)))
    return out


def enumerate_byte_letters():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return [(b, chr(b)) for b in kept] + [(b, chr(256 + i)) for i, b in enumerate(rest)]


@pytest.mark.parametrize("range_bytes, unit_links", [(1 << 16, 1 << 22), (7, 50), (100, 1)])
def test_token_alignment(spark, range_bytes, unit_links):
    from deskspark.llm import token_alignment

    texts = aligned_texts()
    rows = [(i, t, 1, "p", 2.0) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, unit int, pairs string, n double").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.align(table, A_PATH, B_PATH, range_bytes=range_bytes, unit_links=unit_links).collect()}
    assert got == dict(enumerate(expected_alignment(texts)))
    assert token_alignment.align(table.limit(0), A_PATH, B_PATH).count() == 0
    nulls = spark.createDataFrame([(None, "a b", 1, "", 0.0), (None, "a b", 1, "", 0.0)], table.schema)
    assert [tuple(r)[0] for r in token_alignment.align(nulls, A_PATH, B_PATH).collect()] == [None, None]


def test_fragments_compose_in_any_order():
    from deskspark.llm import token_alignment as ta

    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a_ends = np.unique(np.concatenate((rng.integers(1, n + 1, rng.integers(0, n + 1)), [n])))
        b_ends = np.unique(np.concatenate((rng.integers(1, n + 1, rng.integers(0, n + 1)), [n])))
        a_ids, b_ids = np.arange(len(a_ends)), 100 + np.arange(len(b_ends))
        cuts = sorted({0, n, *rng.integers(0, n, 4).tolist()})
        parts, closed = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            i, j = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
            f, g = ta.fragment(a_ids[i], a_ends[i], b_ids[j], b_ends[j])
            parts.append(f)
            closed += [g] if g else []
        while len(parts) > 1:
            k = int(rng.integers(0, len(parts) - 1))
            f, g = ta.compose(parts[k], parts[k + 1])
            parts[k : k + 2] = [f]
            closed += [g] if g else []
        (whole,) = parts
        assert whole.closed and whole.suffix == ([], [])
        closed.append(ta._group(0, *whole.prefix))
        text = ";".join(ta.shown(g) for g in sorted(closed, key=lambda g: g.at))
        common, want, i, j = np.intersect1d(a_ends, b_ends), [], 0, 0
        for c in common:
            k, m = np.searchsorted(a_ends, c) + 1, np.searchsorted(b_ends, c) + 1
            want.append(",".join(map(str, a_ids[i:k])) + "|" + ",".join(map(str, b_ids[j:m])))
            i, j = k, m
        assert text == ";".join(want)
