"""Rules on documents and their hosts' frequent lines against brute force."""

import collections
import re

import pytest

from flighttone.llm import line_rules
from tests.llm.test_operators import ODD, duck

SCHEMA = "doc_id long, text string, source string, host string, row long, n int, h1 string, words int, removed long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", 1, 2, "x", 3, 4) for i, t, s in rows], SCHEMA)


def brute(rows, docs, share):
    keys, hosts = collections.Counter(), collections.Counter()
    split = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    key = lambda x: " ".join(WORD.findall(x.translate(LOWER)))
    for _, t, s in rows:
        hosts[s or ""] += 1
        keys.update({(s or "", key(x)) for x in split(t)})
    for i, t, s in rows:
        words, lines = WORD.findall(t or ""), split(t)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        met = collections.Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if met[w] > 1 for j in range(8)}
        gone = lambda x: keys[s or "", key(x)] > max(docs, share * hosts[s or ""])  # noqa: E731, B023
        left = sum(len(WORD.findall(x)) for x in lines if not gone(x))
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        yield (
            i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated),
            failed, not failed and left >= 20 and left >= 0.5 * len(words), left,
        )


@pytest.fixture(scope="module")
def rows():
    own, notice = " ".join(f"w{i}" for i in range(40)), " ".join(f"n{i}" for i in range(30))
    out = [(i, t, "odd") for i, t in enumerate(ODD)] + [(50, None, None), (51, "", ""), (None, own, None), (None, None, "odd")]
    out += [(100 + i, f"Shared  LINE of\tthe host {'x' * (i % 2)}\n{own} {i}\nshared line of THE host\n\n# {i % 3}", "big") for i in range(60)]
    out += [(200 + i, f"{notice}\n{own[:20]} {i}", "big") for i in range(40)]
    out += [(300 + i, f"{notice}\n{own}", "small") for i in range(3)]
    out += [(400, own, "same")] * 15 + [(401, f"{own} z\n{own} z\n" * 2, "twice"), (402, "v " * 9, "v"), (403, "a b c d e f g h " * 2, "v")]
    out += [(500, " ".join(f"q{i % 5000}" for i in range(60_000)), "long"), (501, "one two three four five six seven", "v")]
    return out


@pytest.mark.parametrize("docs, share", [(10, 0.01), (2, 0.5)])
def test_line_rules(spark, rows, docs, share):
    found = line_rules.judge(table(spark, rows).repartition(5), limit_docs=docs, limit_share=share).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(brute(rows, docs, share))
    # What 40 of 100 documents share is above the first limits only; another host's lines are its own.
    assert {r.kept for r in found if r.doc_id and 200 <= r.doc_id < 300} == {docs == 2}
    assert {r.kept for r in found if r.doc_id and 300 <= r.doc_id < 303} == {docs == 10}


def test_line_rules_as_in_sql(spark, rows):
    said = duck(line_rules.sql().replace("FROM documents", "FROM d3"), [], {"d3": ("doc_id bigint, text varchar, source varchar", rows)})
    assert sorted(map(str, map(tuple, line_rules.judge(table(spark, rows)).collect()))) == sorted(map(str, said))


def test_long_list_of_frequent_lines(spark, rows, monkeypatch):
    """The way for lists that must not be broadcast gives the same."""
    monkeypatch.setattr(line_rules, "small_side", lambda df: df)
    found = line_rules.judge(table(spark, rows)).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(brute(rows, 10, 0.01))


def test_line_rules_of_nothing(spark):
    assert line_rules.judge(table(spark, [])).count() == 0
