from __future__ import annotations

import random
import re

from airlume.llm.lines import RUN, WORDS, remove_repeated_runs


def _plain(rows):
    seen: dict[tuple, tuple] = {}
    numbered = []
    for i, t in rows:
        lines = (t or "").split("\n")
        real = [k for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
        numbered.append((i, t, lines, real))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))

    def runs(lines, real):
        for size in range(1, RUN + 1):
            for p in range(len(real) - size + 1):
                run = tuple(lines[a] for a in real[p : p + size])
                many = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= WORDS
                if size == RUN or many:
                    yield p, size, run
                elif len(real) == size:
                    yield p, size, ("whole", *run)

    for k in order:
        i, _, lines, real = numbered[k]
        for p, _, run in runs(lines, real):
            seen.setdefault(run, (i, p))
    out = []
    for i, t, lines, real in numbered:
        gone = set()
        for p, size, run in runs(lines, real):
            if seen[run] != (i, p):
                gone |= set(real[p : p + size])
        kept = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        out.append((i, len(real), len(gone), kept))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_removed", "kept_text").collect()), key=str)


def test_equals_brute_force(spark, texts):
    draw = random.Random(6)
    pool = [f"line {i}" for i in range(25)] + ["", "  ", "the"]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "a\nb\nc"), (4, "a\nb\n\nc\r"), (5, "x\ny\nz\nx\ny\nz\n"), (6, "same\n" * 9), (7, "same\n" * 2)]
    rows += [(10 + i, "\n".join(draw.choices(pool, k=draw.randint(0, 30)))) for i in range(60)]
    licence = "\n".join(f"licence {i}" for i in range(12))
    rows += [(100 + i, f"own {i}\n{licence}\nown {-i}") for i in range(30)]
    rows += [(None, licence), (200, "\n".join(f"n{i % 5000}" for i in range(9000)))]
    long = "this one line has " + " ".join(f"w{i}" for i in range(9))
    rows += [(300, long), (301, f"a\nb\n{long}\nc"), (302, f"x\n{long}"), (303, f"six words of one line here\nand seven more words of the next"), (304, "k\nsix words of one line here\n \nand seven more words of the next\nj"), (305, "six words of one line here"), (306, "and seven more words of the next\nsix words of one line here")]
    rows += [(310, "short"), (311, "short"), (312, "short\ncopy"), (313, "\nshort\n\ncopy"), (314, "short\nshort"), (315, f"{long}\n{long}"), (None, "short")]
    assert _rows(remove_repeated_runs(texts(rows))) == _plain(rows)
    assert _rows(remove_repeated_runs(texts(rows), hot_rows=5)) == _plain(rows)
    assert remove_repeated_runs(texts([])).count() == 0


def test_whole_repeats_of_a_row_keep_each_other(spark, texts):
    got = _rows(remove_repeated_runs(texts([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])))
    assert got == [(1, 3, 0, "a\nb\nc"), (1, 3, 0, "a\nb\nc"), (2, 3, 3, "")]


def test_long_lines_and_short_copies_go(spark, texts):
    line = " ".join(f"w{i}" for i in range(168))
    got = _rows(remove_repeated_runs(texts([(1, f"a\n{line}\nb"), (2, line), (3, "two\nlines"), (4, "two\nlines"), (5, "two\nlines\nmore"), (6, "")])))
    assert [r[2] for r in got] == [0, 1, 0, 2, 0, 0]


def test_half_of_all_rows_hold_one_line(spark, texts):
    line = "the same long line " * 4
    rows = [(i, f"{line}\nown {i}" if i % 2 else f"own {i}") for i in range(400)]
    assert _rows(remove_repeated_runs(texts(rows), hot_rows=20)) == _plain(rows)
