"""Registered queries on whole texts, against brute force: what their SQL cuts off must not be lost."""

import hashlib
import json
import random
import re

from folio.plans import registry


def run(spark, folder, name, table, schema, rows):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_wer_of_whole_turns(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(f"Word{rng.randrange(60)}" for _ in range(n)) for n in (300, 40, 17, 16, 120)]
    texts += [texts[-1] + " one two three", "", "Any"]
    got = run(spark, tmp_path, "wer", "conversations", "conv_id long, turn int, role string, text string", [(1, k, "user", t) for k, t in enumerate(texts)])
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    want = {(1, k): round(levenshtein(a, b) / len(a), 4) if a else float(bool(b)) for k, (a, b) in enumerate(zip(words, words[1:]), 1)}
    assert {r[:2]: r[2] for r in got} == want and len(got) == len(want)


def test_audition_keys_of_whole_texts(spark, tmp_path):
    texts = ["a" * 50, "a" * 50 + "b", "a" * 50 + "ł\n" * 3000, "", "short"]
    got = run(spark, tmp_path, "audition_keys", "documents", "doc_id long, text string, lang string, source string", [(k, t, "pl", "web") for k, t in enumerate(texts)])
    parts = lambda t: (t, "pl", "web", "r", "m", '{"speed": 1.0}')
    assert dict(got) == {k: hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts(t))).hexdigest()[:12] for k, t in enumerate(texts)}


def test_escapes_of_whole_texts(spark, tmp_path):
    texts = ["it's " * 40, "a" * 30 + "'", "plain", ""]
    got = run(spark, tmp_path, "escapes", "benchmark", "item_id long, text string", list(enumerate(texts)))
    assert {r[0]: r[2] for r in got} == {k: "file '" + t.replace("'", "'\\''") + "'" for k, t in enumerate(texts)}


def test_fingerprints_of_whole_texts(spark, tmp_path):
    texts = ["zażółć", "zazolc", "za", "a\tb\r\n", "ab\n", "汉字 𝄞", "", 'a"b\\c/</\x00\x01\x08\x0c\x1f\x7f\x85\u2028', "".join(map(chr, range(32))), '\\u001F\\\x1f\\\\\x0b"\x1b\x1b']
    got = run(spark, tmp_path, "fingerprints", "documents", "doc_id long, text string, lang string, source string", [(k, t, "pl", "web") for k, t in enumerate(texts)])
    fields = {"language": "pl", "model": "m@r1", "renderer": 1, "settings": {"speed": 1.0, "temperature": 0.7}, "voice": "web", "voice_revision": ""}
    wanted = lambda t: hashlib.sha256(json.dumps(fields | {"text": t}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]
    assert dict(got) == {k: wanted(t) for k, t in enumerate(texts)}


SPOKEN = [
    ("5% & §7 at 3°C", "5 percent and section7 at 3 degrees Celsius", 4),
    ("Dr. Żak, etc. vs. Mr. X", "Doctor Żak, et cetera versus Mister X", 4),
    ("approx. 12.5 % of a.b.c. e.g. i.e. nothing", "approximately 12.5 percent of a.b.c. for example that is nothing", 4),
    ("汉字 1999, no sign", "汉字 1999, no sign", 0),
    ("", "", 0),
]


def test_symbol_rewrite_of_whole_texts(spark, tmp_path):
    got = run(spark, tmp_path, "symbol_rewrite", "documents", "doc_id long, text string", [(k, t) for k, (t, _, _) in enumerate(SPOKEN)])
    assert sorted(got) == [(k, spoken, n) for k, (_, spoken, n) in enumerate(SPOKEN)]


def test_abbreviation_rewrite_of_whole_texts(spark, tmp_path):
    got = run(spark, tmp_path, "abbreviation_rewrite", "benchmark", "item_id long, text string", [(k, t) for k, (t, _, _) in enumerate(SPOKEN)])
    head, said = "Dr. Who met Mrs. Lee, e.g. ", "Doctor Who met Missus Lea, for example "
    assert sorted(r[:3] for r in got) == [(k, said + spoken, head + t) for k, (t, spoken, _) in enumerate(SPOKEN)]
    for (_, spoken, n), (_, text, source, changes) in zip(SPOKEN, sorted(got)):
        changes = json.loads(changes)
        assert len(changes) == 4 + n
        assert all(source[c["start"] : c["end"]] == c["source"] and text[c["spoken_start"] : c["spoken_end"]] == c["spoken"] for c in changes)


def test_greedy_pack_keeps_long_words(spark, tmp_path):
    texts = ["see https://example.org/" + "x" * 200 + " for more", "a" * 61, "a" * 60 + " b", "汉" * 150, "one,two;" * 20 + " end", " \n"]
    got = dict(run(spark, tmp_path, "greedy_pack", "documents", "doc_id long, text string", list(enumerate(texts))))
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k, chunks in got.items():
        assert max(map(len, chunks)) <= 60 and "".join(chunks).replace(" ", "") == "".join(texts[k].split())
    assert got[1] == ["a" * 60, "a"] and got[3] == ["汉" * 60, "汉" * 60, "汉" * 30]
