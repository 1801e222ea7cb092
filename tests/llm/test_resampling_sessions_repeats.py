"""Importance resampling, sessions and repeats against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clauseworks.llm import repeats, resampling, sessions
from clauseworks.llm import suffix_arrays as module
from clauseworks.llm.suffix_arrays import suffix_arrays

# 11 importance resampling


def plain_words(text):
    out, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def plain_resample(docs, target, percent, least_words=20, longest=1, buckets=10_000, seed=2024):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for d, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(x)) >= least_words])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(may[: len(may) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def some_texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "naïve", "ΩMEGA", "x-y", "日本"]
    return [" ".join(r.choice(words[: r.choice([30, 305])]) for _ in range(r.choice([3, 19, 20, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("percent, longest", [(10, 1), (37, 2), (100, 1), (0, 1)])
def test_resampling_equals_plain(spark, percent, longest):
    docs = list(enumerate([*some_texts(230, 1), None, "", "...", "A" * 50_000]))
    docs += docs[:15] + [(None, docs[0][1] + " a" * 20)]
    target = [*some_texts(9, 2), None, "été É"]
    df = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, score int")
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(df, aim, percent, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = plain_resample(docs, target, percent, longest=longest)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len([w for w in want if w[4]]) == len([w for w in want if w[4]]) and resampling.drawn(df, aim, percent, longest=longest).count() == sum(w[4] is not None for w in want)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert resampling.resample(none, one).count() == 0
    assert [tuple(r)[:2] for r in resampling.resample(one, none.select("text"), 100).collect()] == [(1, 30)]


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_ranks_of_ties(spark, ranges):
    rows = [(i % 50, i % 7, True) for i in range(400)] + [(1000, 99, False)]
    df = spark.createDataFrame(rows, "doc_id long, score long, may boolean")
    got = resampling.ranked(df, 0.25, 25, ranges).collect()
    best = sorted(((-s, d) for d, s, may in rows if may))[:100]
    assert sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"]) == [(i + 1, *x) for i, x in enumerate(best)]
    assert len(got) == len(rows)


# 12 sessions

EPOCH = datetime(2024, 1, 1)


def plain_sessions(rows, gap, longest, lateness, kinds=("purchase", "signup"), least=60):
    """rows: (click_id, ts, arrived, client, kind, value) with times in microseconds."""
    once = {}
    for r in sorted((r for r in rows if None not in (r[0], r[1], r[3])), key=lambda r: (r[3], r[1])):
        once.setdefault(r[0], r)
    clients = defaultdict(list)
    for r in once.values():
        clients[r[3]].append(r)
    out = []
    for client, all_rows in clients.items():
        late = [r for r in all_rows if r[2] is not None and r[2] - r[1] > lateness]
        found = []
        for r in sorted((r for r in all_rows if r not in late), key=lambda r: (r[1], r[0])):
            if found:
                before, first = found[-1][0][-1], found[-1][0][0]
                final = before[4] in kinds and before[5] is not None and math.isfinite(before[5]) and before[5] >= least
                why = "end" if final else "gap" if r[1] - before[1] >= gap else "length" if r[1] - first[1] > longest else None
                if why is None:
                    found[-1][0].append(r)
                    continue
                found[-1][1] = why
            found.append([[r], None])
        for i, (clicks, why) in enumerate(found):
            last = clicks[-1]
            if why is None:
                why = "end" if last[4] in kinds and last[5] is not None and math.isfinite(last[5]) and last[5] >= least else "none"
            upto = found[i + 1][0][0][1] if i + 1 < len(found) else math.inf
            cents = sum(math.floor(100 * r[5] + 0.5) for r in clicks if r[5] is not None and math.isfinite(r[5]))
            path = hashlib.sha256(",".join(str(r[0]) for r in clicks).encode()).hexdigest()
            out.append((client, clicks[0][0], clicks[0][1], last[1], len(clicks), sum(clicks[0][1] <= r[1] < upto for r in late), cents, why, path))
    return sorted(out)


def as_frame(spark, rows, zone="timestamp_ntz"):
    at = lambda us: None if us is None else EPOCH + timedelta(microseconds=us)
    return spark.createDataFrame([(i, at(t), at(a), c, k, v, 0) for i, t, a, c, k, v in rows], f"click_id long, ts {zone}, arrived_at {zone}, client_id long, kind string, value double, slice int")


def made_clicks(seed, n=900):
    r, rows, now = random.Random(seed), [], Counter()
    for i in range(n):
        client = r.choice([1, 1, 1, 1, 2, 3, 4, None])
        now[client] += r.choice([0, 0, 1, 30, 300, 600, 800, 899, 900]) * 1_000_000 + r.choice([0, 0, 7])
        ts = None if r.random() < 0.02 else now[client]
        arrived = None if ts is None or r.random() < 0.05 else ts + r.choice([0, 5, 900, 901, 4000]) * 1_000_000
        rows.append((r.choice([i, i, i + 10_000]), ts, arrived, client, r.choice(["view"] * 8 + ["purchase", "signup", None]), r.choice([None, 1.005, 59.99, 60.0, 75.5, -3.25, float("nan"), float("inf")])))
        if r.random() < 0.05:
            rows.append(rows[-1])
    return rows


SECOND = 1_000_000
BASE = int((EPOCH - datetime(1970, 1, 1)).total_seconds()) * SECOND


@pytest.mark.parametrize("seed, rules", [(1, sessions.Rules()), (2, sessions.Rules(chunk=1800 * SECOND, fan=2)), (3, sessions.Rules(gap=1000 * SECOND, longest=600 * SECOND, chunk=3600 * SECOND, fan=3)), (4, sessions.Rules(final_value=1e9, chunk=600 * SECOND, fan=2))])
def test_sessions_equal_plain(spark, seed, rules):
    rows = made_clicks(seed)
    got = sorted(map(tuple, sessions.sessions(as_frame(spark, rows), rules).collect()))
    want = plain_sessions(rows, rules.gap, rules.longest, rules.lateness, least=rules.final_value)
    assert got == [(c, i, s + BASE, e + BASE, *rest) for c, i, s, e, *rest in want]
    assert {w[7] for w in want} >= ({"gap", "length", "none"} if seed == 4 else {"end", "gap", "length", "none"})


def test_one_client_without_a_hard_break(spark):
    """One island of days, dealt out over many chunks and three levels."""
    r, t, rows = random.Random(5), 0, []
    for i in range(4000):
        t += r.choice([1, 60, 200, 899]) * SECOND
        rows.append((i, t, t, 7, "view", 1.0))
    rules = sessions.Rules(chunk=3 * 3600 * SECOND, fan=3)
    got = sorted(map(tuple, sessions.sessions(as_frame(spark, rows, "timestamp"), rules).collect()))
    want = plain_sessions(rows, rules.gap, rules.longest, rules.lateness)
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want] and len(want) > 200


def test_steps_compose():
    r = np.random.default_rng(3)
    ts = np.sort(r.integers(0, 4000, 600)).astype(np.int64)
    ids = np.arange(len(ts))
    cut = [0, 1000, 2000, 3000, 4000]
    steps = [sessions.chunk_steps(ts[(ts >= a) & (ts < b)], ids[(ts >= a) & (ts < b)], a, 90) for a, b in zip(cut, cut[1:])]
    for start in range(-200, 1000, 7):
        s, j = start, int(np.searchsorted(ts, start + 90, side="right"))
        while j < len(ts) and start >= -90:
            s, j = int(ts[j]), int(np.searchsorted(ts, ts[j] + 90, side="right"))
        one = (start, -1)
        for f in steps:
            one = sessions._apply(f, one)
        whole = steps[0]
        for f in steps[1:]:
            whole = sessions.compose(whole, f)
        assert sessions._apply(whole, (start, -1)) == one
        if -90 <= start < 0:
            assert one[0] == s


def test_sessions_of_nothing(spark):
    assert sessions.sessions(as_frame(spark, [])).count() == 0


# 13 repeats


@pytest.mark.parametrize("few", [0, 1000])
@settings(deadline=None, max_examples=200, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=12))
def test_suffix_arrays_equal_sorting(few, monkeypatch, texts):
    """In step, and text by text."""
    monkeypatch.setattr(module, "FEW", few)
    texts = [[*t, 0] for t in texts]
    begins = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = suffix_arrays(np.array(sum(texts, [])), begins)
    for t, a, b in zip(texts, begins, begins[1:], strict=False):
        assert (found[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def plain_repeats(docs, length):
    data = [(d, (x or "").encode()) for d, x in docs]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def repeated_texts(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    shared = [" ".join(word() for _ in range(r.randrange(5, 40))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [r.choice(shared) if r.random() < 0.4 else " ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(200, "ab" * 300), (201, "a" * length), (202, "a" * (length - 1)), (203, "a" * (3 * length)), (204, None), (205, ""), (206, docs[3][1]), (None, docs[4][1]), docs[5], docs[5]]
    return docs + [(300 + i, f"{i:05d}" + "the very common passage that everyone copies, word by word, again and again" * 2 + f"{i:05d}") for i in range(40)]


@pytest.mark.parametrize("length, wide", [(40, repeats.WIDE), (40, 60), (24, 500), (33, 0)])
def test_repeats_equal_plain(spark, length, wide, monkeypatch):
    docs = repeated_texts(length, length)
    df = spark.createDataFrame([(d, x, "k") for d, x in docs], "doc_id long, text string, key string")
    got = Counter(map(tuple, repeats.without_repeats(df, length, wide).collect()))
    assert got == Counter(plain_repeats(docs, length))


def test_long_texts_are_cut_into_slices(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 128)
    monkeypatch.setattr(repeats, "PIECE", 32)
    text = (b"abcdefgh" * 40 + bytes(range(256))) * 2
    starts = []
    for which, first, count, value, _ in repeats.runs([b"x" * 50, text, text[:10], text[:70]], 40):
        starts += [(a, n, v) for i, a, n, v in zip(which.tolist(), first.tolist(), count.tolist(), value.tolist(), strict=True) if i == 1]
    assert [s for a, n, _ in starts for s in range(a, a + n)] == list(range(len(text) - 39)) and max(n for _, n, _ in starts) <= 32
    value_of = {s: v for a, n, v in starts for s in range(a, a + n)}
    same = defaultdict(set)
    for s, v in value_of.items():
        same[text[s : s + 40]].add(v)
    assert all(len(v) == 1 for v in same.values())


def test_window_hashes_tell_windows_apart():
    data = np.frombuffer(b"abcabcabcabd" * 30, np.uint8)
    for length in (24, 40, 200):
        h = list(zip(*repeats.window_hashes(data, length), strict=True))
        windows = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(set(zip(h, windows, strict=True))) == len(set(h)) == len(set(windows))


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
