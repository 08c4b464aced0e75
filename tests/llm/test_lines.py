import re
from collections import Counter

from veilscan.llm import lines, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_op3_equals_brute_force(spark, sf):
    rows = {r.doc_id: r for r in queries.op3_line_frequency(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    hosts = {}
    for d in docs:
        hosts.setdefault(d.source, set()).add(d.text)
    held = Counter((s, line) for s, texts in hosts.items() for t in texts for line in {lines.normal(x.encode()) for x in t.split("\n") if WORD.search(x)})
    for d in docs:
        r, want = rows[d.doc_id], base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        lost = sum(len(WORD.findall(x)) for x in d.text.split("\n") if WORD.search(x) and (n := held[d.source, lines.normal(x.encode())]) >= 20 and n > 0.05 * len(hosts[d.source]))
        assert r.n_removed_words == lost and r.kept == (not r.base_failed and want[0] - lost >= 0.3 * want[0])


def test_common_lines_deplete_but_copies_do_not(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{body(i)}\nSeen  on Site {i}", "h") for i in range(40)]
    rows += [(100 + i, body("same"), "h") for i in range(40)]
    rows += [(200 + i, "\n".join(" ".join(f"{w}{k}" for w in "menu line of this fine old site now".split()) for k in "abcdefgh") + f"\nown {i}", "h") for i in range(40)]
    got = {r.doc_id: r for r in lines.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_rows=0).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 4 for i in range(40))
    assert all(got[100 + i].kept and got[100 + i].n_removed_words == 0 for i in range(40))
    assert all(not got[200 + i].kept and not got[200 + i].base_failed for i in range(40))


def test_odd_rows(odd, none):
    rows = lines.line_rules(odd).collect()
    assert len(rows) == odd.count()
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(odd.collect(), key=lambda d: d.doc_id), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(d.text or "")
    assert lines.line_rules(none).count() == 0
