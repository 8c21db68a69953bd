"""Every pipeline stage on awkward tables: nulls, empty and very long texts, ties, repeated rows,
extra columns with clashing names, no rows; and each stage against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, line string, words int, n_tokens int, table string, copies long"


def _prose(rng, n, words=None):
    words = words or [f"word{k}" for k in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def _rows(texts):
    return [(i, t, "en", "s", len(t or ""), -5.0, f"x{k % 2}", "l", k % 3, 7, "t", 9) for k, (i, t) in enumerate(texts)]


def _frame(spark, texts):
    return spark.createDataFrame(_rows(texts), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels that make plain prose good and starred words bad."""
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(6)
    texts = [(k, _prose(rng, 60) + "." if k % 3 else " ".join(w + "***" for w in _prose(rng, 60).split())) for k in range(300)]
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k, _ in texts] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), texts


@pytest.fixture(scope="module")
def awkward(folder):
    rng = random.Random(7)
    long_ = "\n".join(_prose(rng, 14) + "." for _ in range(6000))
    same = _prose(rng, 80) + "."
    near = same.split()
    near[40] = "other"
    return [
        *folder[1], (1000, None), (1001, ""), (1002, " \n\t\n"), (None, _prose(rng, 50) + "."), (None, None), (1003, long_), (1004, long_ + "\n" + _prose(rng, 20) + "."),
        (1005, same), (1005, same), (1006, same), (1007, " ".join(near)), (1008, "one"), (1009, "one two\n\none two"), (-5, _prose(rng, 70) + "."), ((1 << 63) - 1, _prose(rng, 70) + "."), (1010, "é ü " * 40), (1010, _prose(rng, 60)),
    ]


def _values(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_a_table_without_rows(spark, folder, name):
    out = STAGES[name](spark, _frame(spark, []), folder[0])
    assert out.count() == 0 and (name == "packing" or out.columns == _frame(spark, []).columns)


def test_quality_keeps_whole_rows(spark, folder, awkward):
    df = _frame(spark, awkward)
    got, before = _values(STAGES["quality classifier"](spark, df, folder[0])), _values(df)
    assert got.keys() <= before.keys() and all(before[r] == n for r, n in got.items())
    texts = {r[1] for r in got}
    assert all((r[1] in texts) == (r in got) for r in before)
    assert sum(k % 3 > 0 for k, _ in folder[1]) * 0.97 < sum(r[0] is not None and 0 <= r[0] < 300 and r[0] % 3 > 0 for r in got)
    assert sum(r[0] is not None and 0 <= r[0] < 300 and r[0] % 3 == 0 for r in got) < 5


def _edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(p + (x != y), d[j] + 1, d[j - 1] + 1)
        if min(d) > most:
            return most + 1
    return d[-1]


def test_line_dedup_against_brute_force(spark, folder):
    rng = random.Random(9)
    base = [_prose(rng, 7) for _ in range(12)]
    texts = []
    for k in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice("qzé")
            lines.append(rng.choice(["", " ", "Short.", "".join(line), "  " + "".join(line) + "\r"]))
        texts.append((k, "\n".join(lines)))
    texts += [(90, None), (91, ""), (92, "\n \n"), (93, "only here"), (94, "only here")]
    got = {r.doc_id: (r.text, r.n_chars) for r in STAGES["line dedup"](spark, _frame(spark, texts), folder[0]).collect()}
    first, want = {}, {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            first.setdefault(line.strip(" \t\x0b\f\r"), len(first))
    names = [x.encode() for x in first]
    dropped = {x for b, x in enumerate(names) if len(x) >= 25 and any(len(a) >= 25 and _edits(a, x, 2) <= 2 for a in names[:b])}
    seen = set()
    for i, t in texts:
        kept = []
        for line in (t or "").split("\n"):
            x = line.strip(" \t\x0b\f\r")
            if not x or (x not in seen and x.encode() not in dropped):
                kept.append(line)
            seen.add(x)
        if "".join(kept).strip(" \t\x0b\f\r"):
            want[i] = ("\n".join(kept), len("\n".join(kept)))
    assert got == want and len(want) < len(texts) - 4


def test_line_dedup_of_awkward_rows(spark, folder, awkward):
    got = STAGES["line dedup"](spark, _frame(spark, awkward), folder[0]).collect()
    assert all(r.text and r.score == -5.0 and r.n_chars == len(r.text) for r in got)
    assert {r.doc_id for r in got} >= {1003, 1004, 1005, 1008, -5, (1 << 63) - 1} and not {r.doc_id for r in got} & {1000, 1001, 1002, 1006}
    assert next(r for r in got if r.doc_id == 1004).text.count("\n") == 0


def _sets(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup_against_brute_force(spark, folder, awkward):
    texts = [x for x in awkward if x[0] is not None]
    got = _values(STAGES["near dedup"](spark, _frame(spark, texts), folder[0]))
    sets = [_sets(t) for _, t in texts]
    group = list(range(len(texts)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                group[find(a)] = find(b)
    members = {}
    for k in range(len(texts)):
        members.setdefault(find(k), []).append(k)
    assert sum(got.values()) == len(members)
    kept = Counter((r[0], r[1]) for r in got)
    for own in members.values():
        lowest = min(texts[k][0] for k in own)
        assert sum(kept[t] for t in {texts[k] for k in own}) == 1 and any(kept[texts[k]] for k in own if texts[k][0] == lowest)
    assert len(texts) - len(members) >= 5


def test_mixing_of_awkward_rows(spark, folder, awkward):
    from streamweft.llm.mixing import mixing_rates

    df = _frame(spark, awkward)
    got, before = _values(STAGES["mixing"](spark, df, folder[0])), _values(df)
    rates = Counter()
    for r in mixing_rates(df, spark.read.parquet(f"{folder[0]}/labels.parquet")).collect():
        rates[r.doc_id] += r.copies
    by_id = Counter()
    for r, n in got.items():
        assert r in before
        by_id[r[0]] += n
    assert +by_id == +rates


def test_packing_of_awkward_rows(spark, folder, awkward):
    rows = STAGES["packing"](spark, _frame(spark, awkward), folder[0]).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _ in awkward)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by) <= np.ceil(total / 4096) + 1
