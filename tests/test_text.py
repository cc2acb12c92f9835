"""The clean-up steps, case by case."""

import pytest

from densefold.operators import text


def run(spark, step, given):
    df = spark.createDataFrame([(g,) for g in given], "t string")
    return [r.t for r in step(df, "t").collect()]


CASES = {
    text.strip_ansi: [("\x1b[31mred\x1b[0m", "red"), ("\x1b]0;title\x07x", "x"), ("\x1b]0;t\x1b\\x", "x"), ("a\x1b", "a"), ("\x1b[1", ""), ("\x1b\x1b[31mx", "[31mx"), ("\x1bé→", "→"), ("plain →×", "plain →×"), ("", ""), (None, None)],
    text.rstrip_lines: [("a  \nb\t\n", "a\nb\n"), ("a\r\nb\r\n", "a\nb\n"), ("a 　", "a"), ("x  y", "x  y"), ("\n \n", "\n\n"), ("", "")],
    text.collapse_blank_runs: [("a\n\n\n\nb", "a\n\nb"), ("\n\n\na", "\na"), ("a\n\n\n", "a\n\n"), ("a\n\nb\n", "a\n\nb\n"), ("", "")],
    text.collapse_dup_runs: [("a\na\na\nb", "a (×3)\nb"), ("x (×3)\nx (×3)", "x (×3)\nx (×3)"), ("a\nb\na", "a\nb\na"), ("a\na\n", "a (×2)\n"), ("", ""), (None, None), ("\n\n", " (×2)\n")],
    text.elide_blobs: [("A" * 1024, "A" * 1024), ("A" * 1025, "[@dense/1.blob 1025 chars]"), ("é " + "a" * 4000 + " b " + "c" * 2000, "é [@dense/1.blob 4000 chars] b [@dense/1.blob 2000 chars]")],
    text.fold_common_prefix: [
        ("\n".join(f"/srv/a/bcdef{i}/x" for i in range(8)), "\n".join(f"/srv/a/bcdef{i}/x" for i in range(8))),
        ("\n".join(f"/srv/a/bcde/{i}" for i in range(8)), "@dense/1.prefix=/srv/a/bcde/\n" + "\n".join(map(str, range(8)))),
        ("\n".join(f"/srv/a/bcde/{i}" for i in range(7)), "\n".join(f"/srv/a/bcde/{i}" for i in range(7))),
        ("\n".join(f"/srv/a/bcd/{i}" for i in range(9)), "\n".join(f"/srv/a/bcd/{i}" for i in range(9))),
        ("\n\n".join(f"/srv/é/bcde/{i}" for i in range(8)) + "\n", "@dense/1.prefix=/srv/é/bcde/\n" + "\n\n".join(map(str, range(8))) + "\n"),
    ],
}


@pytest.mark.parametrize("step", CASES, ids=lambda s: s.__name__)
def test_step(spark, step):
    given, wanted = zip(*CASES[step], strict=True)
    assert run(spark, step, given) == list(wanted)


def test_chain_is_stable(spark):
    t = ["\x1b[1mx\x1b[0m  \r\n\r\n\r\nb\nb\n", "a\n" * 50, "", None]
    once = run(spark, text.clean, t)
    assert once[:2] == ["x\n\nb (×2)\n", "a (×50)\n"]
    assert run(spark, text.clean, once) == once
