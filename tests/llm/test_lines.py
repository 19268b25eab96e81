import hashlib
import random

from threshline.llm import lines


def brute(rows):
    """Chunks by their own text, in order of (id, text hash, place)."""
    seen, first = {}, {}
    for k1, k2, text in rows:
        if text:
            for at, (a, b) in enumerate(lines.chunks(text)):
                if b - a > 1:
                    c = "\n".join(text.split("\n")[a:b])
                    seen[c] = seen.get(c, 0) + 1
                    key = (k1 is not None, k1 or 0, k2, at)
                    first[c] = min(first.get(c, key), key)
    out = []
    for k1, k2, text in rows:
        if text is None:
            out.append(None)
            continue
        ls, keep = text.split("\n"), []
        for at, (a, b) in enumerate(lines.chunks(text)):
            c = "\n".join(ls[a:b])
            if b - a < 2 or seen[c] == 1 or first[c] == (k1 is not None, k1 or 0, k2, at):
                keep += ls[a:b]
        out.append("\n".join(keep))
    return out


def corpus():
    block = "\n".join(f"shared line {i} {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(30))
    own = lambda k, n: "\n".join(f"own {k} {i}" for i in range(n))
    texts = [f"{own(k, k % 5 + 1)}\n{block}\n{own(k + 100, 3)}" for k in range(12)]
    return [*texts, None, "", "one line", "same\nsame\n" * 100, own(1, 60), own(1, 60), block, block.replace("line 7", "line seven"), texts[0]]


def test_chunks_partition_and_resist_shifts():
    text = "\n".join(f"line {i} {i * i}" for i in range(500))
    cut = lines.chunks(text)
    assert [a for a, _ in cut] == [0, *[b for _, b in cut[:-1]]] and cut[-1][1] == 500
    ls = text.split("\n")
    before = {"\n".join(ls[a:b]) for a, b in cut}
    moved = ["new", *ls[:250], "also new", *ls[250:]]
    after = ["\n".join(moved[a:b]) for a, b in lines.chunks("\n".join(moved))]
    assert sum(c in before for c in after) > 0.9 * len(cut)
    assert max(b - a for a, b in lines.chunks("x\n" * 1000)) <= lines.MOST + 1


def test_against_brute_force(spark):
    rows = [(i if i != 3 else None, t, "en", 9, i) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k2 string, marks int, n_chars long")
    keyed = docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS h", "text").collect()
    want = {(r.doc_id, r.h): t for r, t in zip(keyed, brute([(r.doc_id, r.h, r.text) for r in keyed]), strict=True)}
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    out = {r.doc_id: r for r in got.collect()}
    for (doc, _), t in want.items():
        assert out[doc].text == t
        assert (out[doc].k2, out[doc].marks) == ("en", 9)
        assert out[doc].n_chars == (before[doc].n_chars if t == before[doc].text else len(t))


def test_repeated_rows_and_empty(spark):
    text = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect())
    assert got[:2] == [(1, text)] * 2 and len(got[2][1]) < len(text)
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_runs(rows):
    """Lines of every run, two lines or longer and without two blank neighbours, that began at an earlier place as well."""
    first, out = {}, []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ls = row[2].split("\n")
        gone = set()
        for a in range(len(ls)):
            for b in range(a + 2, len(ls) + 1):
                if not (ls[b - 2].strip() or ls[b - 1].strip()):
                    break
                if first.setdefault(tuple(ls[a:b]), (row[:2], a)) != (row[:2], a):
                    gone |= set(range(a, b))
        out.append((row[0], "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return sorted(out, key=str)


def test_whole_repeated_runs_go(spark):
    rng = random.Random(3)
    passages = ["\n".join(f"passage {p} line {i}" for i in range(n)) for p, n in enumerate([2, 3, 5, 9])]
    texts = [f"before {k}\n{passages[k % 4]}\nbetween {k}\n{passages[rng.randrange(4)]}\nafter {k}" for k in range(12)]
    texts += ["a\n\n\nb\n\nc", "x\n\n\ny\n\nc", "same\nsame\nsame\nsame", passages[3], passages[3], "passage 3 line 2", "lone\npassage 3 line 2\nlone too", ""]
    texts += ["\n".join(rng.choice(["p", "q", "r", ""]) for _ in range(12)) for _ in range(12)]
    docs = spark.createDataFrame([(i if i != 5 else None, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    keyed = [tuple(r) for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text)", "text").collect()]
    got = lines.dedup_runs(docs, facts=True).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_runs(keyed)
    assert all(r.n_chars == len(r.text) for r in got)
    out = {r.doc_id: r for r in got}
    assert out[4].text == "before 4\nbetween 4\nafter 4"
    assert (out[16].text, out[16].removed_lines, out[16].removed_chunks) == ("", 9, out[16].n_chunks)


def test_colliding_hashes_are_told_apart_by_their_bytes(spark, monkeypatch):
    """Under a hash of too few bits different pieces meet; the comparison finds it and another key is tried."""
    tried = []
    whole = lines._marked
    monkeypatch.setattr(lines, "_digest", lambda data, salt: hashlib.blake2b(data, digest_size=16).digest() if salt else bytes(15) + bytes([len(data) % 2]))
    monkeypatch.setattr(lines, "_marked", lambda *a: tried.append(a[-1]) or whole(*a))
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb"), (3, "d\ne")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup_runs(docs).collect()) == [(1, "a\nb\nc"), (2, "x"), (3, "d\ne")]
    assert tried == [0, 1]


def test_very_long_texts(spark):
    long = "\n".join(f"line {i % 40_000}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, None), (3, "line 7\nline 8")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_runs(docs).collect()}
    assert got == {1: "\n".join(f"line {i}" for i in range(40_000)), 2: None, 3: ""}


def test_chunks_decide_before_pairs(spark, monkeypatch):
    """A chunk that occurred before goes as such; pairs are matched only outside the copies, and both together leave the whole runs' result."""
    kept, whole = [], lines._marked
    monkeypatch.setattr(lines, "_marked", lambda *a: kept.append((a[3], whole(*a))) or kept[-1][1])
    passage = "\n".join(f"passage line {i} {i * i}" for i in range(60))
    texts = [f"own 0\n{passage}", f"own 1\nmore\n{passage}\nend", f"{passage}\n\n\nx", "passage line 7 49\npassage line 8 64", "a\n\n\nb", "c\n\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_runs(docs).collect())
    assert got == brute_runs([tuple(r) for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text)", "text").collect()])
    pieces, marked = kept[0]
    seen = set()
    for r in sorted(marked.collect(), key=lambda r: r.c0):
        ls, parts, gone = texts[r.c0].split("\n"), pieces(texts[r.c0]), set(r.gone or [])
        cut = [(a, b) for a, b in lines.chunks(texts[r.c0]) if b - a > 1 and "\n\n\n" not in "\n".join(ls[a:b])]
        copies = {parts[at][:2] for at in gone if parts[at][3] is None}
        assert copies == {(a, b) for a, b in cut if tuple(ls[a:b]) in seen}
        assert len(copies) > 8 or r.c0 not in (1, 2)
        assert not any(x <= a and b <= y for x, y in copies for a, b in (parts[at][:2] for at in gone if parts[at][3] is not None))
        seen |= {tuple(ls[a:b]) for a, b in cut}
