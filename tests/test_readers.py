"""Readers of texts by hand-made cases: marks of rules, cites and their lists, sentences, quotations, commands, patches; bundles."""

import random

import pytest

from lexmill.operators import authorities, commands, extraction, guards, outline, quotes
from lexmill.sources import bundles

NAMES = authorities.Names(local_rule="L. U. Civ. R.", pleadings=(("Compl.", "Compl."), ("Am. Compl.", "Am. Compl.")))


def paths(text: str) -> list[str]:
    """Marks with their indentation before a colon ('(a) 4:(1)') to paths."""
    marks = [(x.rpartition(":")[2].strip("()"), int(x.partition(":")[0]) if ":" in x else 0) for x in text.split()]
    return ["-".join(p) if p else "." for p, _ in outline.place(marks)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(a) 4:(1) 8:(A) 12:(i) 12:(ii) 8:(B) 4:(2) (b)", "a a-1 a-1-A a-1-A-i a-1-A-ii a-1-B a-2 b"),
        ("(a) (b) (c) (d) (e) (f) (g) (h) (i) (j)", "a b c d e f g h i j"),
        ("(a) (b) (c) (d) (e) (f) (g) (h) 4:(1) 4:(2) 8:(i) 8:(ii) (i) 4:(1)", "a b c d e f g h h-1 h-2 h-2-i h-2-ii i i-1"),
        ("(a) 4:(1) 4:(2) 8:(A) 8:(B) 12:(1) 12:(2) 4:(3)", "a a-1 a-2 a-2-A a-2-B a-2-B-1 a-2-B-2 a-3"),
        ("(a) 4:(1) (2) 4:(2) 4:(3)", "a a-1 . a-2 a-3"),  # a wrapped line that begins with the next mark
        ("(b) (a) (b) (z)", ". a b ."),
        ("(y) " * 0 + " ".join(f"({c})" for c in "abcdefghijklmnopqrstuvwxyz") + " (aa) (bb)", " ".join([*"abcdefghijklmnopqrstuvwxyz", "aa", "bb"])),
    ],
)
def test_marks(text, want):
    assert paths(text) == want.split()


def test_marks_that_can_be_read_twice():
    got = outline.place([("a", 0), ("1", 2), ("A", 4), ("1", 6), ("2", 3)])
    assert got[-1] == (("a", "1", "A", "2"), [("a", "2")])
    assert outline.place([("a", 0), ("1", 2), ("A", 4), ("1", 6), ("2", 2)])[-1] == (("a", "2"), [])


def test_marks_by_all_readings():
    """The cheapest of all readings, found one by one, costs as much as the one that is taken."""
    rng = random.Random(5)
    for _ in range(150):
        marks = [(rng.choice(["a", "b", "c", "1", "2", "3", "A", "B", "i", "ii"]), rng.choice([0, 2, 4])) for _ in range(rng.randint(1, 7))]

        def cost(k, levels, marks=marks):
            if k == len(marks):
                return 0
            mark, indent = marks[k]
            found = [(outline._misfit(level, indent, levels), outline._placed(levels, level, n, indent)) for level, n in outline._readings(mark, levels)]
            again = any(m == mark for m, _ in marks[k + 1 :])
            best = [c + cost(k + 1, after) for c, after in found]
            if not found or (again and all(c > 0 for c, _ in found)):
                best.append(outline.UNPLACED + cost(k + 1, levels))
            return min(best)

        total, levels = 0, outline.EMPTY
        for (mark, indent), (path, _) in zip(marks, outline.place(marks), strict=True):
            if path is None:
                total += outline.UNPLACED
                continue
            level, n = next((level, n) for level, n in outline._readings(mark, levels) if outline._paths([(mark, 0)], (level,)) and sum(x is not None for x in levels[:level]) == len(path) - 1)
            total += outline._misfit(level, indent, levels)
            levels = outline._placed(levels, level, n, indent)
        assert total == cost(0, outline.EMPTY)


def test_openings_of_a_text():
    def x(rule=None, mark=None, sub=None, indent=0):
        return {"rule": rule, "mark": mark, "sub": sub, "indent": indent}

    lines = [x("7"), x(mark="a"), None, x("5"), x(mark="b", sub="1"), x("7.1"), x(mark="a"), x(mark="A", sub="z")]
    got = [None if o is None else [y["anchor"] for y in o] for o in outline.openings(lines)]
    assert got == [["7"], ["7-a"], None, None, ["7-b", "7-b-1"], ["7.1"], ["7.1-a"], ["7.1-a-A"]]
    assert outline.openings(None) == [] and outline.openings([]) == []


CITES = [
    ("See Bell v. Twombly, 550 U.S. 544, 556–57, 570 (2007); 12 F.3d 34 (2d Cir. 1994).", "case:550 us 544:556–57, 570 case:12 f3d 34:"),
    ("550 U.S. at 556 n. 3, 12 F. Supp. 2d 5. 12F.3d 4, x12 F.3d 4", "case-short::556 case:12 fsupp2d 5:"),
    ("ECF No. 16 at 2; Doc. 16-2, 17 and 18 at 3; Compl. ¶¶ 12-14, 16; id. ¶ 5.", "record:16:2 record:16-2: record:17: record:18:3 pleading:Compl.: id::"),
    ("Fed.R.Civ.P. 26(a)(1)(A)(i), (ii), and (iv) & 56; Ohio R. Evid. 401; N.D. R. App. P. 4.", "rule:26-a-1-A-i: rule:26-a-1-A-ii: rule:26-a-1-A-iv: rule:56: rule:401: rule:4:"),
    ("Rule 12(b)(1) and (6); Local Criminal Rules 7(b), (c); Local Bankruptcy Rule 9.", "bare-rule:12-b-1: bare-rule:12-b-6: local-rule:7-b: local-rule:7-c: local-rule:9:"),
    ("42 U.S.C. § 1983, 1985 and 12 CFR 1026.1", "statute:statute:42usc1983: statute:statute:42usc1985: statute:statute:12cfr1026.1:"),
    ("§§ 1, 2(a), (b) and 3; Section 5 of Title 9; sections 5 through 9", "statute-short:1: statute-short:2: statute-short:3: statute-short:5: statute-short:5:"),
    ("", ""), ("no cite at all, 12 of them", ""),
]


@pytest.mark.parametrize(("text", "want"), CITES)
def test_authorities(text, want):
    def show(c):
        what = c.anchor if "rule" in c.kind else c.entry if c.kind in ("record", "pleading") else c.short if c.kind == "statute-short" else c.key
        return f"{c.kind}:{what or ''}:{c.pin or ''}"

    cites = authorities.scan(text, NAMES)[0]
    assert " ".join(show(c) for c in cites) == want
    assert all(text[c.start : c.end] == c.raw for c in cites)


def test_paragraph_ranges():
    read = lambda t: authorities.scan(t, NAMES)[0][0].paragraphs
    assert read("Compl. ¶¶ 45-7, 50") == (45, 46, 47, 50) and read("Compl. ¶ 9–3") == (9,) and read("Compl. ¶¶ 2 and 3 & 5") == (2, 3, 5)


def test_list_stops_and_siblings():
    assert authorities.scan("42 U.S.C. § 1983, 12 plaintiffs", NAMES)[1] == [("12", 18)]
    assert authorities.scan("Section 552.101, 1972 Miss. Laws 4", NAMES)[1] == []
    assert authorities.sibling(["b", "1"], ["2"]) == ["b", "2"] and authorities.sibling(["a", "1", "A", "i"], ["c"]) == ["c"]
    assert authorities.sibling(["b"], ["1"]) is None and authorities.sibling(["a", "1", "A", "i"], ["ii"]) == ["a", "1", "A", "ii"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He lived in Mass. The car went.", 2), ("at 5 p.m. Then he left.", 2), ("in Ind. Trial began.", 2), ("Ind. Trial R. 5 applies. Ok.", 2), ("See 100 Wash. 2d 1 there.", 1), ("Under Ill. Const. art. I it is. So.", 2),
        ("Mass. Gen. Laws ch. 5 says. Good.", 2), ("8 Del. C. § 141 holds. Then.", 2), ("He was ill. The man left.", 2), ("Mr. J. Doe went. He sat.", 2), ("He said “Stop. Go.” and left. Then.", 2), ("See Fed. R. Civ. P. 12. Ok.", 2),
    ],
)
def test_sentences(text, want):
    assert len(quotes.sentence_spans(text)) == want


def test_quotations_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b ", "“", "”", '"', "\n"]) for _ in range(rng.randint(0, 30)))
        want, at = [], 0
        while at < len(t):
            close = {"“": "”", '"': '"'}.get(t[at])
            end = t.find(close, at + 1) if close else -1
            if end > at + 1 and not (t[at] == '"' and "\n" in t[at:end]):
                want.append((at + 1, end))
                at = end
            at += 1
        assert quotes.quote_spans(t) == want
    assert quotes.quote_spans("“" + "x" * 1501 + "”") == [] and quotes.quote_spans("“" + "x" * 1500 + "”") == [(1, 1501)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("17 C.F.R. § 1.1031(a)-1 says", "17 C.F.R. § 1.1031(a)-1"), ("Am. Samoa Code Ann. § 1.01", "Am. Samoa Code Ann. § 1.01"), ("section 301, 302, or 303 is", "section 301, 302, or 303"), ("(See § 255.2(a) and (b) there", "§ 255.2(a) and (b)"), ("[13 FR 8183, Dec.", "13 FR 8183"), ("1996—Pub. L. 104–292 did", "Pub. L. 104–292"), ("endorsers. (See § 255.5.)", "§ 255.5"), ("section 5, 12 records, and 3", "section 5")],
)
def test_extraction_forms(text, want):
    assert max((x[2] for x in extraction.cite_spans(text)), key=len) == want


def test_commands():
    assert commands.read_command("a 'b c'\"d\\\"\"<<E x\n1\nE\ne") == [("word", "a"), ("quoted", 'b cd"'), ("word", "x"), ("op", "\n"), ("doc", "1"), ("word", "e")]
    assert commands.read_command("a 'open") == [("word", "a"), ("quoted", "open")] and commands.read_command("") == []
    for text in ("cp a b", "x=1 tee f", "a >b", "perl -pi -e x f", "git stash", "sudo rm x", "python -c 'import shutil; shutil.move(a, b)'"):
        assert commands.command_writes(text), text
    for text in ("cat a", "a 2>&1 >/dev/null", "git status", "echo 'cp a b'", "perl -ne x f", "# rm x"):
        assert not commands.command_writes(text), text
    assert commands.program_text("x = ('a'\n 'é')  # c") == "x = (\n\naé\n\n)  # c" and commands.program_text("(") is None


def test_patches():
    add = [{"kind": "add", "hunks": [{"hint": None, "lines": [{"mark": "+", "text": "a"}]}]}]
    assert commands.patched_text(None, add) == ("a\n", None) and commands.patched_text("x", []) == ("x", None)
    assert commands.patched_text(None, [{"kind": "update", "hunks": []}]) == (None, "no such file")
    assert commands.patch_operations("no patch") == [] and commands.patch_operations(None) == []


def test_import_along_a_chain(spark):
    """Each row shares a key with the one before: every second one is added."""
    rows = spark.createDataFrame([(1, i, [f"k{i}", f"k{i + 1}"]) for i in range(9)] + [(2, i, ["hot", f"x{i}"]) for i in range(30)] + [(3, 0, ["s", "t"]), (3, 1, ["t"])], "case_id int, line_no int, keys array<string>")
    stored = spark.createDataFrame([(3, "s", "a1")], "case_id int, key string, auth_id string")
    got = {(r.case_id, r.line_no): r.plan for r in guards.ledger_import(rows, stored).collect()}
    assert [got[1, i] for i in range(9)] == ["add" if i % 2 == 0 else "skip: repeated" for i in range(9)]
    assert [i for i in range(30) if got[2, i] == "add"] == [0]
    assert (got[3, 0], got[3, 1]) == ("skip: stored", "add")
    assert guards.ledger_import(rows.limit(0), stored).count() == 0


def test_bundles_are_written_once(spark, tmp_path):
    parts = spark.createDataFrame([(1, "a", b"x"), (1, "b", b"y"), (2, "a", b"z")], "bundle int, name string, content binary")
    path = f"file://{tmp_path}/batch"
    bundles.write_bundles(parts, "bundle", path)
    assert bundles.checked(*bundles.read_bundles(spark, path, "bundle"), "bundle").count() == 0
    with pytest.raises(FileExistsError):
        bundles.write_bundles(parts, "bundle", path)
    with pytest.raises(ValueError, match="twice"):
        bundles.write_bundles(parts.union(parts), "bundle", f"file://{tmp_path}/other")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["batch"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A. 1. a. b. i. ii. (1) (2) c. 2. B.", "A A-1 A-1-a A-1-b A-1-b-i A-1-b-ii A-1-b-ii-1 A-1-b-ii-2 A-1-c A-2 B"),
        ("a. b. c. d. e. f. g. h. i. j.", "a b c d e f g h i j"), ("a. i. ii. b. i.", "a a-i a-ii b b-i"), ("2. 1. 3. 2. AA.", ". 1 . 2 ."), ("1. (a) (b) 2. (a)", "1 1-a 1-b 2 2-a"), ("", ""),
    ],
)
def test_marks_of_an_outline(text, want):
    got = outline.place_dotted([(x.endswith("."), x.strip("().")) for x in text.split()])
    assert " ".join("-".join(p) if p else "." for p, _ in got) == want
