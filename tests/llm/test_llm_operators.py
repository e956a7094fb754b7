"""Operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import importlib.util
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from deskspark.llm import (
    arc_warc,
    bpe_stream,
    chat_windows,
    components,
    divergence_rules,
    importance,
    interleave_shards,
    minhash_tensor,
    pfair_mix,
    quotient_dedup,
    suffix_dedup,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _bucket int, key string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKENIZER = None
if importlib.util.find_spec("public_tokenizers"):
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(25)]
    out = [None, "", " \n\t", "one", "One", "one two", "x" * 300, "é" * 90, "a b c\n" * 60, "a b c\n" * 60]
    for text in base:
        out += [text, text]
        near = text.split(" ")
        near[40] = "changed"
        out.append(" ".join(near))
        out.append(text[:200] + " tail " + " ".join(rng.choice(words) for _ in range(60)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 7 else None, 0, 1, "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[11]], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quotient_filter_merges_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 12, 500).astype(np.uint64) << np.uint64(50) for _ in range(3)]
    filters = []
    for p in parts:
        values, counts = np.unique(np.concatenate([p, np.repeat(p[:1], 400)]), return_counts=True)
        made = quotient_dedup.CountingQuotientFilter(values, counts)
        filters.append(quotient_dedup.CountingQuotientFilter.from_bytes(made.to_bytes()))
    values, counts = quotient_dedup.CountingQuotientFilter.merged(filters).items()
    want = Counter(np.concatenate([np.concatenate([p, np.repeat(p[:1], 400)]) for p in parts]).tolist())
    assert dict(zip(values.tolist(), counts.tolist())) == dict(want)


def test_exact_dedup(docs, empty):
    pairs = [(r.doc_id, r.text or "") for r in docs.collect()]
    by = defaultdict(list)
    for i, t in pairs:
        by[t].append(i)
    for r in rows_of(quotient_dedup.duplicate_groups(docs)):
        same = by[dict(pairs)[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"]) == (max(same), len(same))
        assert r["kept"] == (r["doc_id"] == max(same))
    kept = quotient_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in by.values())
    assert quotient_dedup.duplicate_groups(empty).count() == 0 and quotient_dedup.exact_dedup(empty).count() == 0


def linked_components(pairs, rule):
    sets = {}
    for i, t in pairs:
        w, k = WORD.findall((t or "").encode().lower()), rule.words
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and name[a] != name[b]:
                    if rule.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
                        name[a] = name[b] = min(name[a], name[b])
                        changed = True
    return {i: (len(sets[i]), name[i]) for i in sets}


def test_near_duplicates_broadcast_hot_keys_and_bitmaps_only(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.Random(i // 3).choices(words, k=30)) + (" end" if i % 3 else "") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plans = []

    def planned(run):
        def noted(df, *args, **named):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return run(df, *args, **named)

        return noted

    for module in (minhash_tensor, components):
        monkeypatch.setattr(module, "freeze", planned(module.freeze))
    monkeypatch.setattr(type(docs), "isEmpty", planned(type(docs).isEmpty))
    planned(lambda df: df)(minhash_tensor.near_duplicates(docs, minhash_tensor.NearRule(words=3, percent=60)))
    joins = re.findall(r"(?:Broadcast\w+|SortMerge)Join .*", "\n".join(plans))
    assert sum(j.startswith("SortMerge") for j in joins) >= 10
    # Fewer than 1,000 hot keys, or the 2,048 rows of a bitmap: no table that grows with the documents.
    assert all("_hot#" in j or "_map#" in j for j in joins if j.startswith("Broadcast"))


@pytest.mark.parametrize("rule", [minhash_tensor.NearRule(words=3, percent=85), minhash_tensor.NearRule(block=4)])
def test_near_duplicates(docs, empty, rule):
    want = linked_components([(r.doc_id, r.text) for r in docs.collect()], rule)
    got = rows_of(minhash_tensor.near_duplicates(docs, rule))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert minhash_tensor.near_duplicates(empty, rule).count() == 0
    kept = minhash_tensor.one_of_each(docs, rule)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


@pytest.mark.parametrize("crowd", [65_536, 2])
def test_suffix_dedup(docs, empty, crowd):
    rule = suffix_dedup.PassageRule(crowd=crowd)
    pairs = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    first = {}
    for i, b in sorted(pairs.items()):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for r in rows_of(suffix_dedup.removal_report(docs, rule)):
        b = pairs[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < r["doc_id"]:
                gone[j : j + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r["n_removed"], r["n_spans"]) == (int(gone.sum()), runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.removal_report(empty, rule).count() == 0


def test_a_prefilter_misses_no_key(spark):
    from deskspark.llm.spread import maybe_among

    rows = spark.range(-3000, 3000).withColumnRenamed("id", "k")
    kept = {r["k"] for r in maybe_among(rows, "k", rows.where("k % 7 = 0")).collect()}
    wanted = {k for k in range(-3000, 3000) if k % 7 == 0}
    assert wanted <= kept and len(kept) < len(wanted) + 5
    assert maybe_among(rows, "k", rows.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 30])
def test_two_stage_order(letters):
    rng = np.random.default_rng(letters)
    text = np.concatenate([rng.integers(1, letters + 1, 700), [0]]).astype(np.uint8)
    data, order = text.tobytes(), suffix_dedup.two_stage_order(text, 40)
    assert sorted(order.tolist()) == list(range(len(data)))
    keys = [data[i : i + 40] for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("letters", [1, 2, 30])
def test_suffixes_that_start_no_string_are_not_sorted(letters, monkeypatch):
    rng = np.random.default_rng(letters)
    contexts = [bytes([9]) + bytes(rng.integers(97, 97 + letters, n, dtype=np.uint8)) for n in (76, 50, 49, 76, 60) * 40]
    docs, rule, sorted_rows = rng.integers(0, 9, len(contexts)), suffix_dedup.PassageRule(), []
    plain = suffix_dedup._sorted_directly
    monkeypatch.setattr(suffix_dedup, "_sorted_directly", lambda *a: sorted_rows.append(len(a[1])) or plain(*a))
    owner, least = suffix_dedup._first_documents(contexts, docs, rule)
    strings = [(i, c[j : j + 50]) for i, c in enumerate(contexts) for j in range(1, len(c) - 49)]
    first = {}
    for i, string in strings:
        first[string] = min(first.get(string, 9), docs[i])
    assert owner.tolist() == [i for i, _ in strings] and least.tolist() == [first[x] for _, x in strings]
    assert sum(sorted_rows) <= len(strings) + len(contexts)


@pytest.mark.skipif(TOKENIZER is None, reason="no tokenizer file")
def test_bpe(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(TOKENIZER)
    odd = [None, "", "a<|endoftext|>b", "ab" * 4000, " " * 70_000 + "x", "\n" * 66_000 + " y", "日本語" * 900, "it's \x00"]
    table = spark.createDataFrame(list(enumerate(odd + texts())), "doc_id bigint, text string")
    for r in bpe_stream.decode(bpe_stream.encode(table, TOKENIZER), TOKENIZER).collect():
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == theirs.decode(want, skip_special_tokens=False)
    assert bpe_stream.encode(empty, TOKENIZER).count() == 0


@pytest.mark.skipif(TOKENIZER is None, reason="no tokenizer file")
def test_bpe_replaces_columns_of_its_names(spark):
    table = spark.createDataFrame([("one two", 5, "x", None, 1.5)], "text string, IDS int, _bpe_text string, decoded int, `a.b` double")
    out = bpe_stream.decode(bpe_stream.encode(table, TOKENIZER), TOKENIZER)
    assert sorted(out.columns) == sorted(["text", "_bpe_text", "a.b", "ids", "decoded"])
    row = out.first()
    assert (row["decoded"], row["_bpe_text"], row["a.b"]) == ("one two", "x", 1.5) and len(row["ids"]) == 8


def test_lookahead_follows_the_longest_chain():
    merges = [(b"b", b"c"), (b"a", b"bc"), (b"x", b"a"), (b"z", b"q")]
    assert bpe_stream.sufficient_lookahead(merges) == 3  # b|c, then a|bc, then x|a


def test_chat_windows(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be # brief"), (2, 0, "system", "alone"), (None, 0, None, None), (3, 0, "user", "w " * 2000)]
    rows += [(1, t, ("user", "assistant")[t % 2], "tok <x> \\h " * rng.randrange(1, 90)) for t in range(1, 40)]
    rows += [(4, 0, "user\nx", "### a: </turn>\n"), (4, 1, "assistant", "\\b\\h\\l"), (4, 1, "assistant", "\\b\\h\\l")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat_windows.format_windows(table)
    budget = chat_windows.WindowBudget()
    assert all(r.n_tokens <= budget.fresh + budget.history + 20 for r in windows.where("conv_id = 1").collect())
    assert windows.where("conv_id = 1").count() > 2
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for r in rows_of(chat_windows.conversation_digests(windows)):
        turns = sorted(by[r["conv_id"]])
        blob = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(blob.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_windows.format_windows(table.limit(0)).count() == 0


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "\r\n\r\nWARC/1.0\r\n", "é" * 50]
    rows = [(i, None if i == 2 else f"http://h/{i} x", h) for i, h in enumerate(html)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in arc_warc.archive(table).collect()}
    for i, h in enumerate(html):
        same = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i].payload_bytes == len((h or "").encode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if same == i else ("revisit", same))
    assert arc_warc.archive(table.limit(0)).count() == 0


def test_archives_give_repeated_pages_their_own_records(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "u", "a"), (0, "v", "a")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = arc_warc.archive(table).collect()
    assert len({r.record_id for r in got}) == len(got) == 4
    assert sorted((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got if r.page_id) == [
        (1, "response", None, b"a"), (1, "response", None, b"a"), (1, "response", None, b"b")
    ]
    (other,) = [r for r in got if r.page_id == 0]
    assert (other.record_type, other.refers_to) == ("revisit", 1)


def test_archives_keep_pages_without_an_id(spark):
    rows = [(None, "u0", "a"), (1, "u1", "a"), (2, "u2", "a"), (None, "u3", "b"), (None, "u4", "b"), (None, None, None)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = arc_warc.archive(table).collect()
    assert {(r.url, r.page_id, r.record_type, r.refers_to, bytes(r.payload), r.payload_bytes) for r in got} == {
        ("u0", None, "revisit", 2, b"", 1),
        ("u1", 1, "revisit", 2, b"", 1),
        ("u2", 2, "response", None, b"a", 1),
        ("u3", None, "response", None, b"b", 1),
        ("u4", None, "response", None, b"b", 1),
        (arc_warc.NO_URL, None, "response", None, b"", 0),
    }
    assert len(got) == len({r.record_id for r in got}) == len(rows)


def test_every_arc_file_starts_with_a_version_block(spark, tmp_path):
    n, batch = 2 * arc_warc.FILE_RECORDS + 10, "spark.sql.execution.arrow.maxRecordsPerBatch"
    table = spark.range(0, n, 1, 1).selectExpr("id AS page_id", "'http://h/' || id AS url", "'p' || id AS html")
    before = spark.conf.get(batch)
    spark.conf.set(batch, 1000)
    try:
        arc_warc.write_arc(table, str(tmp_path / "arc"))
        got = sorted(r.page_id for r in arc_warc.archive(table).select("page_id").collect())
    finally:
        spark.conf.set(batch, before)
    assert got == list(range(n))
    files = [list(arc_warc.parse_arc(arc_warc._unzipped(f.read_bytes()))) for f in (tmp_path / "arc").glob("part-*")]
    assert all([r["kind"] for r in f].index("filedesc") == 0 and len(f) <= arc_warc.FILE_RECORDS for f in files)
    assert sorted(f[0]["version"] for f in files) == [1, 1, 2]


def test_arc_versions_and_cut_records():
    block = arc_warc.ARC_1.format(origin="o").encode()
    one = f"filedesc://a 0.0.0.0 20010101000000 text/plain {len(block)}\n".encode() + block + b"\n"
    record = b"http://x/ 1.2.3.4 20010101000000 text/html 3\nabc\n"
    assert [r["body"] for r in arc_warc.parse_arc(one + record)][1] == b"abc"
    with pytest.raises(ValueError, match="cut off"):
        list(arc_warc.parse_arc(one + record[:-3]))


def test_shards_match_the_mixture(docs, empty):
    got = rows_of(interleave_shards.assign_shards(docs, 4))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == docs.count()
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    sources = Counter(r["source"] for r in got)
    for (shard, source), n in Counter((r["shard"], r["source"]) for r in got).items():
        assert abs(n - sources[source] / 4) <= 2
    assert interleave_shards.assign_shards(empty).count() == 0


def test_pfair_mix(docs, empty):
    weights = {"s0": 5.0, "s1": 1.0, "s2": 1.0, "s3": 2.5, None: 0.5}
    placed = pfair_mix.schedule(docs, weights, block_rows=2, period=64)
    assert sorted(r["_mix"]["position"] for r in placed.collect()) == list(range(docs.count()))
    assert pfair_mix.mix(docs, weights).columns == docs.columns
    assert pfair_mix.mix(empty, {}).count() == 0


def slot_by_slot(blocks, weights):
    """Walks every slot; of the sources whose next block is released takes the earliest deadline."""
    total, done, out, slot = sum(weights), [0] * len(blocks), [], 0
    while any(d < n for d, n in zip(done, blocks)):
        ready = [
            (-(-(done[k] + 1) * total // weights[k]), k)
            for k in range(len(blocks))
            if done[k] < blocks[k] and done[k] * total // weights[k] <= slot
        ]
        if ready:
            deadline, k = min(ready)
            out.append((k, done[k], done[k] * total // weights[k], deadline, slot))
            done[k] += 1
        slot += 1
    return out


def test_pfair_mix_follows_a_second_scheduler(spark):
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(1, 7)
        blocks, weights = [rng.randrange(0, 40) for _ in range(n)], [rng.randrange(1, 30) for _ in range(n)]
        assert list(pfair_mix.earliest_deadlines(blocks, weights)) == slot_by_slot(blocks, weights)
    sizes, weights = {None: 11, "a": 95, "b": 40, "c": 3}, {None: 1.0, "a": 4.0, "b": 2.0, "c": 9.0}
    rows = [(None if i == 0 else i, s) for s, m in sizes.items() for i in range(m)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string")
    placed = [r["_mix"] for r in pfair_mix.schedule(table, weights, block_rows=4).collect()]
    names = list(sizes)
    want, start = {}, 0
    for k, i, release, deadline, slot in slot_by_slot([-(-m // 4) for m in sizes.values()], [int(w) for w in weights.values()]):
        want[names[k], i] = (release, deadline, slot, start)
        start += min(4, sizes[names[k]] - 4 * i)
    assert len(placed) == len(rows)
    for r in placed:
        release, deadline, slot, first = want[r["source"], r["block"]]
        assert (r["release"], r["deadline"], r["slot"]) == (release, deadline, slot)
        assert r["block"] == r["source_rank"] // 4 and r["position"] == first + r["source_rank"] % 4


def test_clashing_names_give_way(spark):
    table = spark.createDataFrame([(i, "s", i, -1, "x") for i in range(9)], "doc_id bigint, source string, _mix int, mix_position int, `a.b` string")
    mixed = pfair_mix.mix(table, {"s": 1.0}, position_col="mix_position")
    assert sorted(mixed.columns) == sorted(table.columns)
    assert sorted((r["_mix"], r["doc_id"]) for r in mixed.collect()) == [(i, i) for i in range(9)]
    assert sorted(r["mix_position"] for r in mixed.collect()) == list(range(9))
    assert pfair_mix.schedule(table, {"s": 1.0}).select("_mix.position").count() == 9


def test_pfair_mix_keeps_to_the_real_weights(spark):
    third = {f"s{i}": (0.5 if i == 0 else 1 / 38) ** 0.5 for i in range(20)}
    total = sum(third.values())
    sizes = {s: int(2000 * w / total) for s, w in third.items()}
    rows = [(f"{s}:{i}", s) for s, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id string, source string")
    placed = [r["_mix"] for r in pfair_mix.schedule(table, third, block_rows=1, period=64).collect()]
    assert sorted(r["position"] for r in placed) == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in placed)
    seen = Counter()
    for r in sorted(placed, key=lambda r: r["slot"]):
        seen[r["source"]] += 1
        if min(sizes[s] - seen[s] for s in sizes) <= 0:
            break
        t = r["slot"] + 1
        assert all(abs(seen[s] - t * w / total) < 1 for s, w in third.items())
    assert t > 1500


def test_pfair_mix_takes_any_number_of_sources(spark):
    n = 5000
    table = spark.range(2 * n).selectExpr("id AS doc_id", f"nullif(concat('s', id % {n}), 's7') AS source")
    placed = pfair_mix.schedule(table, pfair_mix.tempered_weights(table, 0.5)).select("_mix.*").collect()
    assert len({r.source for r in placed}) == n
    assert sorted(r.position for r in placed) == list(range(2 * n))
    assert all(r.release <= r.slot < r.deadline for r in placed)


def test_quality_rules(docs, empty):
    rows = rows_of(divergence_rules.assess(docs))
    by = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        words = [w.decode() for w in WORD.findall(by[r["doc_id"]].encode())]
        wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        spots = {i + k for i in range(len(words) - 2) for k in range(3) if wins[tuple(words[i : i + 3])] > 1}
        lines = [x for x in by[r["doc_id"]].split("\n") if WORD.search(x.encode())]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert (r["n_repeat_words"], r["n_dup_lines"]) == (len(spots), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 50 or 2 * len(spots) > len(words))
    passing = divergence_rules.passing(docs)
    assert passing.columns == docs.columns
    assert sorted(r.doc_id for r in passing.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    assert divergence_rules.assess(empty).count() == 0


def test_importance_prefers_text_like_the_target(spark, empty):
    rng = random.Random(1)
    good = [f"g{i}" for i in range(40)]
    bad = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60))) for i in range(200)] + [(900, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    targets = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "id bigint")
    got = rows_of(importance.resample(table, targets, 100))
    held_out = [r for r in got if 100 <= r["doc_id"] < 200]
    assert sum(r["kept"] == (r["doc_id"] % 2 == 1) for r in held_out) >= 0.95 * len(held_out)
    assert next(r for r in got if r["doc_id"] == 900)["log_weight"] == 0
    assert sorted(r["rank"] for r in got) == list(range(201))
    assert importance.resample(empty, targets, 5).count() == 0


def test_importance_against_plain_counts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [rows[5], (70, rows[6][1]), (71, None), (None, "w1 w2"), (72, "W1\tw2")]
    table = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id bigint, text string, key double, rank int").repartition(4)
    targets, model = list(range(0, 30)), importance.ImportanceModel(buckets=128, smoothing=0.5)

    def grams(text):
        found = [w.lower() for w in WORD.findall((text or "").encode())]
        hashes = [int(importance.ngrams.word_hashes([w])[0][0]) for w in found]
        pairs = [int(importance.ngrams.mixed(np.array([a * int(importance.ngrams.M1) + b & (1 << 64) - 1], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
        return [h % 128 for h in hashes + pairs]

    raw, wanted = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in targets:
            wanted.update(grams(t))
    def log_p(counts, b):
        return np.log((counts[b] + 0.5) / (sum(counts.values()) + 0.5 * 128))
    want = []
    for i, t in rows:
        weight = sum(log_p(wanted, b) - log_p(raw, b) for b in grams(t))
        digits = hashlib.md5(f"{model.seed}:{'' if i is None else i}".encode()).hexdigest()[:13]
        want.append((i, weight, len(grams(t)), weight - np.log(-np.log((int(digits, 16) + 0.5) / (1 << 52)))))
    want.sort(key=lambda r: (-round(r[3], 9), r[0] is not None, r[0] or 0))
    ids = spark.createDataFrame([(i,) for i in targets + targets], "id bigint")
    got = sorted(importance.resample(table, ids, 20, model).collect(), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["n_grams"]) for r in got] == [(w[0], w[2]) for w in want]
    assert np.allclose([r["log_weight"] for r in got], [w[1] for w in want])
    assert np.allclose([r["key"] for r in got], [w[3] for w in want])
    assert [r["rank"] for r in got] == list(range(len(rows))) and sum(r["kept"] for r in got) == 20


def test_pipeline_of_an_empty_table(spark, tmp_path):
    if TOKENIZER is None:
        pytest.skip("no tokenizer file")
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_follow_each_other(spark):
    if TOKENIZER is None:
        pytest.skip("no tokenizer file")
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = {r["doc_id"] for r in rows_of(divergence_rules.assess(docs)) if r["kept"]}
    by = defaultdict(list)
    for i in left:
        by[rows[i].text].append(i)
    left = {max(v) for v in by.values()}
    near = linked_components([(i, rows[i].text) for i in left], minhash_tensor.NearRule())
    left = {i for i, (_, c) in near.items() if i == c}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == left and len(out) == len(left)
    for r in out:
        assert r.text == rows[r.doc_id].text
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and 4 * r.n_tokens == len(r.ids)


def test_pipeline_rows_hold_the_mixed_order(spark):
    if TOKENIZER is None:
        pytest.skip("no tokenizer file")
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "source", "mix_position").collect()
    left = spark.createDataFrame([(r.doc_id, r.source) for r in out], "doc_id bigint, source string")
    weights = pfair_mix.tempered_weights(left, corpus_pipeline.MIX_POWER)
    want = {r["doc_id"]: r["_mix"]["position"] for r in rows_of(pfair_mix.schedule(left, weights))}
    assert {r.doc_id: r.mix_position for r in out} == want
    assert sorted(want.values()) == list(range(len(out)))
