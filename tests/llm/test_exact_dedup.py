import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from folio.llm import common, exact_dedup

SCHEMA = "doc_id long, text string, part string, seq int"


def norm(text):
    return (text or "").encode().translate(None, common.SPACE)


def brute(rows):
    out = []
    for r in rows:
        same = [s for s in rows if norm(s[1]) == norm(r[1])]
        best = min(same, key=lambda s: (-len(s[1] or ""), s[0] is None, s[0] or 0))
        out.append((r[0], best[0], len(same), hashlib.sha256(norm(r[1])).hexdigest()))
    return sorted(out, key=repr)


@given(st.lists(st.binary(max_size=6), max_size=30))
def test_trie(keys):
    trie, seen = exact_dedup.PatriciaTrie(), {}
    for key in keys:
        node = trie.node(key)
        assert node.value == seen.get(key)
        node.value = seen[key] = seen.get(key, (key, 0))[:1] + (seen.get(key, (key, 0))[1] + 1,)
    assert sorted(trie.values()) == sorted(seen.values())


def rows():
    rng = random.Random(4)
    out = [(k, rng.choice(["a b c", "ab\tc", "abc ", "long " * 3000, "long" * 3000, "", None, " \n", "x\u00a0y", "xy", "prefix", "prefixes"]), "p", 1) for k in range(120)]
    return out + [(5, "row", "p", 1), (5, "row", "p", 1), (None, "row", "p", 1), (None, "alone", "p", 1)]


def test_groups(spark):
    data = rows()
    for budget in (48_000_000, 2000):
        entries, owners = exact_dedup.groups(spark.createDataFrame(data, SCHEMA).repartition(3), budget)
        assert owners.filter("owns").count() == len({norm(r[1]) for r in data})
    got = exact_dedup.exact_groups(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == brute(data)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({norm(r[1]) for r in data}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_dedup_keeps_whole_rows(spark):
    data = rows()
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, SCHEMA))
    assert got.columns == ["doc_id", "text", "part", "seq"]
    kept = got.collect()
    assert {norm(r["text"]) for r in kept} == {norm(r[1]) for r in data} and len(kept) == len({norm(r[1]) for r in data})
    assert {r["text"] for r in kept if norm(r["text"]) == b"abc"} == {"a b c"}


def test_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
