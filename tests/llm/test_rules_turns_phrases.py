"""Line rules, turn repair and collocations against brute force, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import collocations, line_rules, turn_repair

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row long, n long, words string"
LONG = "\n".join(" ".join(f"w{(k * 7 + j) % 977}" for j in range(40)) for k in range(4_000))
ODD = [(1, "the cat sat\non the mat", "en", "a", 1, 2, "x"), (1, "the cat sat\non the mat", "en", "a", 1, 2, "x"), (2, None, None, None, None, None, None), (None, "ein Haus am See", "de", None, 3, 1, ""), (3, "", "en", "b", 0, 0, ""), (4, "  \n\t ", "en", "b", 0, 0, ""), (5, LONG, "en", "b", 9, 0, ""), (6, "É é. ;; x", None, "b", 9, 0, "")]


# --- line rules


def measured(text):
    words = re.findall(r"[^ \t-\r]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def normal(line):
    return " ".join(re.findall(r"[^ \t-\r]+", line)).translate({k: k + 32 for k in range(65, 91)})


def judged_by_hand(rows, least=20, most=100, share=30):
    holders = {}
    for host, text in rows:
        for line in set(map(normal, (text or "").split("\n"))):
            if line:
                holders.setdefault((host, line), set()).add(text)
    out = []
    for host, text in rows:
        n, chars, symbols, dup, again = measured(text or "")
        gone = sum(len(normal(x).split()) for x in (text or "").split("\n") if normal(x) and len(holders[host, normal(x)]) > most)
        failed = n < 20 or 100 * again > 30 * n
        out.append((n, chars, symbols, dup, again, failed, not failed and n - gone >= least and 100 * (n - gone) >= share * n))
    return out


def random_documents(n, seed):
    rng = random.Random(seed)
    shared = ["Read our  POLICY here", "read our policy Here\t", "all # rights $ reserved", "x", "é É ñ one two three four five six seven eight nine ten"]
    rows = []
    for k in range(n):
        lines = [" ".join(rng.choice(["a", "b#", "C", "dé", "e<>"]) + str(rng.randrange(9)) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(6))]
        lines += [rng.choice(shared) for _ in range(rng.randrange(4))] + lines[: rng.randrange(3)]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), rng.choice(["h1", "h2", None])))
    return rows + [(n, None, "h1"), (None, rows[0][1], rows[0][2]), rows[1]]


def test_line_rules_against_brute_force(spark):
    rows = random_documents(300, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = line_rules.judged(line_rules.numbered(docs, "doc_id", "source", "text"), most=8)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = [(i, *x) for (i, _, _), x in zip(rows, judged_by_hand([(h, t) for _, t, h in rows], most=8))]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, expected))
    assert {r.kept for r in got.collect()} == {True, False} and any(not x[-1] and not x[-2] for x in expected)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_line_rules_find_lines_by_broadcast_and_by_shuffle(spark, hot):
    rows = spark.createDataFrame([(k, f"t{k % 9}", "k" if k % 2 else f"k{k % 5}", 1) for k in range(60)], "row long, body string, name string, words long").withColumn("key", F.encode("name", "utf-8")).drop("name")
    common = line_rules.common_lines(rows, 3)
    assert {(bytes(r.key), r.n) for r in common.collect()} == {(b"k", 9), *((f"k{k}".encode(), 6) for k in range(5))}
    found = line_rules.removed_lines(rows, common, hot)
    wanted = rows.join(common.select("key"), "key", "left_semi")
    assert sorted(r.row for r in found.collect()) == sorted(r.row for r in wanted.collect())


def test_line_rules_clean_texts(spark):
    boiler = [f"Subscribe  to our newsletter {k % 2}" for k in range(12)]
    body = lambda k: "\n".join(" ".join(f"v{k}x{j}y{i}" for i in range(10)) for j in range(3))
    rows = [(k, f"{boiler[k]}\n\n{body(k)}", "h", k) for k in range(12)] + [(50, "\n".join([boiler[0], boiler[1]] * 5), "h", 0), (51, body(7) + "\n" + boiler[0], "other", 0)]
    kept = {r.doc_id: r.text for r in line_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, source string, row int"), most=5).collect()}
    assert set(kept) == {*range(12), 51}
    assert all(kept[k] == "\n" + body(k) for k in range(12)) and kept[51] == body(7) + "\n" + boiler[0]


def test_line_rules_count_copies_once(spark):
    text = "\n".join(" ".join(f"u{j}z{i}" for i in range(12)) for j in range(4))
    rows = [(k, text, "h") for k in range(300)]
    got = line_rules.judged(line_rules.numbered(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "source", "text"))
    assert got.where("kept").count() == 300


def test_line_rules_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = line_rules.judged(line_rules.numbered(docs, "doc_id", "source", "text")).collect()
    assert len(got) == len(ODD) and sum(r.n_words == 0 for r in got) == 3 and all(r.base_failed for r in got if r.n_words < 20)
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.word_chars, long.n_symbols, long.n_dup_lines, long.n_repeat_words) == measured(LONG)
    assert line_rules.judged(line_rules.numbered(docs.limit(0), "doc_id", "source", "text")).count() == 0
    assert line_rules.clean(docs.limit(0)).count() == 0


# --- turn repair


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = re.sub("[ \t-\r]", "", text)
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """cost, edits, repaired rows by a search over all edits, cheapest and least first."""
    marks = faults(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        follow, name = (2, 2, 3, 2)[state], ("user", "user", "assistant", "user")[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, follow, (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if marks[i] not in (1, 2):
                more = 5 if marks[i] == 3 else 0
                if role[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1, (*out, (role, text))))
                if role[:1] == name[0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, follow, (*out, (role, text))))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, follow, (*out, (name, text))))


def digest(conv_id, rows):
    out = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{'-' if conv_id is None else f'+{conv_id}'}\0{r[1]}\0{r[2]}".encode()).digest())
    out.sort(key=key)
    said = [(r, t) for _, r, t in out]
    turns = [t for t, _, _ in out if t is not None]
    marks = faults(said)
    cost, audit, repaired = cheapest(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv_id, gaps, *(marks.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def random_conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None])
            text = rng.choice(["Hi.", "Yes!", "so", "what?  ", " \t", None, f"I say {rng.randrange(99)}.", "é ñ"])
            rows.append((rng.choice([conv, conv, conv, conv]), rng.choice([turn, turn, turn, turn + 3, None]), role, text, 1))
    return rows + [(None, 0, "user", "a.", 1), (None, 1, "assistant", "b.", 1), *[(n, None, "user", "same.", 1)] * 40, *[(n, 1, "assistant", "same.", 1)] * 3]


CONV = "conv_id long, turn long, role string, text string, at int"


def repaired_rows(spark, rows):
    damaged = turn_repair.damaged(spark.createDataFrame(rows, CONV).repartition(3))
    there = damaged.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies")
    return turn_repair.digested(damaged, turn_repair.edits(there))


@pytest.mark.parametrize("bits", [16, 1])
def test_turn_repair_against_brute_force(spark, monkeypatch, bits):
    """Whole conversations in one chunk, and in chunks of two rows."""
    monkeypatch.setattr(turn_repair, "CHUNK_BITS", bits)
    rows = random_conversations(60, 3)
    got = repaired_rows(spark, rows).collect()
    convs = {}
    for c, *row, _ in rows:
        convs.setdefault(c, []).append(row)
    assert sorted(map(str, map(tuple, got))) == sorted(str(digest(c, r)) for c, r in convs.items())


def test_turn_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs = {}
    for c, *row in rows:
        convs.setdefault(c, []).append(row)
    got = turn_repair.query(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(digest(c, r) for c, r in convs.items())


def test_survivors_chain_and_give_out_settled_edits():
    rng = random.Random(9)
    for _ in range(200):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Hi.", "so", "", "a!", "b?"])) for _ in range(rng.randrange(1, 14))]
        marks = faults(rows)
        cost, audit, _ = cheapest(rows)
        cut = sorted(rng.choices(range(len(rows) + 1), k=3))
        parts = [p for p in (list(zip(marks, rows))[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])) if p]
        ends = turn_repair.chained([turn_repair.table_of([(m, r[0]) for m, r in p]) for p in parts])
        got = ""
        for k, (part, (entry, leave)) in enumerate(zip(parts, ends)):
            alive, out = turn_repair.Survivors(entry), []
            for m, r in part:
                out += alive.push(turn_repair.steps_of(m, r[0]))
            rest, tail = alive.finish(None if k == len(parts) - 1 else leave)
            got += "".join([*out, *rest]) + tail
        assert got == audit, (rows, cost)


def test_survivors_hold_the_unresolved_alone():
    alive, most = turn_repair.Survivors(), 0
    for k in range(20_000):
        alive.push(turn_repair.steps_of(0, "ua"[k % 2] + "x"))
        most = max(most, alive.held)
    assert most < 40


def test_repaired_rows_are_legal(spark):
    rows = turn_repair.identified(spark.createDataFrame(random_conversations(40, 8), CONV), "conv_id", "turn", "role", "text")
    for r in turn_repair.repaired(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "step", "role", "text"))).alias("rows")).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in r.rows))
    assert turn_repair.repaired(rows.limit(0)).count() == 0


def test_turn_repair_of_an_empty_table(spark):
    assert repaired_rows(spark, []).count() == 0


# --- collocations


def mined(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:j] for p, a in phrases.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        found = []
        for p, a in phrases.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    fixed = ["New York", "new york City hall", "in spite of", "on the other hand", "é ñ Ü", "hall of", "the other"]
    rows = []
    for _ in range(n):
        words = [rng.choice([rng.choice(fixed), rng.choice(["the", "of", "a", "to"]), f"w{min(rng.randrange(60), rng.randrange(60))}"]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ;"]) for w in words)))
    return rows + [("en", None), ("en", ""), ("xx", "one two one two")]


@pytest.mark.parametrize("top, ahead, max_bits", [(2000, 2, 27), (12, 1, 27), (5, 2, 15)])
def test_collocations_against_brute_force(spark, top, ahead, max_bits):
    """With all candidates, with few (in several batches), and with maps so small that phrases hit by chance."""
    rows = random_texts(600, 2)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=5, top=top, ahead=ahead, max_bits=max_bits)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(mined(rows, 5, top))


def test_collocations_settle_in_batches(spark, monkeypatch):
    limits, seen = collocations.limits_of, []
    monkeypatch.setattr(collocations, "limits_of", lambda c, n: seen.append(n) or limits(c, n))
    rows = random_texts(400, 5)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, top=6, ahead=1)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(mined(rows, 4, 6)) and 24 in seen


def test_collocation_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**15, 5 * 10**15 + 1)], "a long, b long").select(collocations.ratio(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == 2_000_000 * 3 * 10**15 // (5 * 10**15 + 1)


def test_collocations_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = [(x, t) for _, t, x, *_ in ODD]
    got = collocations.collocations(docs, least=30)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(mined(rows, 30, 2000))
    assert collocations.collocations(docs.limit(0)).count() == 0
