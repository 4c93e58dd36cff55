"""Pipes against the tools that a shell would run, in the C locale."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quarryline.functions.patterns import posix_pattern
from quarryline.operators import pipes, workspace

LINES = [
    "the cat  sat", "b,2,x", "a,1", "", "a,1", "  lead", "10 ten", "9 nine", "-3 minus", "alpha+beta", "a(b)c", "x\ty\tz", "Apple", "apple", "the the end", "", "", "tail,5,y,z", "ü umlaut ß", "9 nine", "zz|q", "a.b*c", "cost $5", "back\\slash",
]

#: Commands that both must agree on.
COMMANDS = [
    "cat", "cat -n", "cat -E", "cat -b", "head -n 3", "head -3", "head -n -20", "head -c 20", "tail -n 4", "tail -n +20", "tail -c 18", "tail -2", "wc -l", "wc -w", "wc -c", "sort", "sort -r", "sort -u", "sort -n", "sort -nr", "sort -f", "sort -fu", "sort -nu",
    "sort -t , -k 2", "sort -t , -k 2,2n", "sort -k 2", "sort -k 2,2r -k 1,1", "sort -s -k 1,1", "sort -t, -k2,2 -u", "sort -b", "sort | uniq", "sort | uniq -c", "sort | uniq -d", "sort | uniq -u", "uniq", "uniq -c", "uniq -i", "sort -f | uniq -ic",
    "cut -d , -f 2", "cut -d, -f 2-", "cut -d, -f -2", "cut -d, -f 3,1", "cut -s -d , -f 1", "cut -c 1-3", "cut -c 2", "cut -c 3-", "cut -f 2", "cut -f 2-", "grep a", "grep -v a", "grep -c a", "grep -n a", "grep -o 'a.'", "grep -on 't[ahe]'", "grep -i APPLE", "grep -w the",
    "grep -x a,1", "grep -m 2 a", "grep -F a.b", "grep -e cat -e nine", "grep 'alpha+'", "grep -E 'alpha\\+|nine'", "grep 'a\\|b'", "grep 'a(b)'", "grep '^[[:digit:]]'", "grep '[[:space:]]$'", "grep '^$'", "grep -vc '^$'", "grep '\\(the\\) \\1'", "grep 'a*'", "grep -E 'e{1,2}n'", "grep '$5'",
    "tr a-z A-Z", "tr -d aeiou", "tr -s ' '", "tr -s a-z", "tr ' ' '\\n'", "tr -cs A-Za-z '\\n'", "tr '[:upper:]' '[:lower:]'", "tr abc x", "tr -d '[:punct:]'", "tr -s ' ,' '\\n\\n'", "nl", "nl -b a", "nl -ba -v 5 -s :", "paste -s", "paste -s -d ,", "paste - - -", "paste -d ',;' - - - - -",
    "sed s/a/X/", "sed s/a/X/g", "sed -n 2,4p", "sed -n '$p'", "sed 2d", "sed '3,$d'", "sed ' /^$/d'", "sed -n ' /the/p'", "sed 's/\\(a\\)\\(.\\)/\\2\\1/'", "sed -E 's/(t)(h)/\\2\\1/g'", "sed 's/the/[&]/g'", "sed y/abc/xyz/", "sed 5q", "sed -n '5q;p'", "sed G", "sed '1!d'", "sed -n =", "sed '2p;s/a/Q/'", "sed 's/APPLE/p/I'",
    "sed '0~5d'", "sed '1~3!d'", "sed ' /nine/!s/a/1/;3q'", "sed -n 's/a/Z/p'", "sed 's,/,_,g'", "sed 's/a\\/b/c/'", "sed 's/x*/-/'", "sed -e s/a/b/ -e s/b/c/", "sed '2,+2d'", "sed 's/;/:/; s/,/;/g'", "grep a | sed -n 2p", "sort | head -n 5 | nl", "grep , | cut -d , -f 1 | sort | uniq -c | sort -rn | head -n 2",
    "tail -n +3 | sort -u | tail -n 3", "sort | nl | tail -n 2", "cut -d ' ' -f 1 | sort | uniq -dc", "rg -i apple", "rg 'a|b' | wc -l",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(10 * i, x) for i, x in enumerate(LINES, 1)], "line_no long, line string").repartition(3).cache()


def shell(command, data):
    run = subprocess.run(command.replace("rg ", "grep -E ") if command.startswith("rg") else command, shell=True, input=data, capture_output=True, env={**os.environ, "LC_ALL": "C.UTF-8", "PATH": "/usr/bin:/bin"})
    out = run.stdout.decode(errors='replace')
    return out.removesuffix("\n").split("\n") if out else []


@pytest.mark.parametrize("command", COMMANDS)
def test_as_the_real_tools(spark, lines, command):
    # a pipe of commands in C order; counts and numbers have no padding here
    real = "export LC_ALL=C; " if "sort" in command or "-c" in command else ""
    expected = shell(real + command.replace("rg ", "grep -E "), ("\n".join(LINES) + "\n").encode())
    found = [r.line for r in pipes.run_pipe(lines, command).orderBy("line_no").collect()]
    if "head -c" in command or "tail -c" in command:
        assert "\n".join(found).rstrip("\n") == "\n".join(expected).rstrip("\n")
        return
    if "cut -c" in command:  # characters here, bytes there
        found, expected = [[x for x, whole in zip(rows, LINES, strict=True) if whole.isascii()] for rows in (found, expected)]
    padded = any(x in command for x in ("nl", "uniq -", "cat -n", "cat -b", "wc"))
    assert [x.lstrip(" ") for x in found] == [x.lstrip(" ") for x in expected] if padded else found == expected


def test_a_million_lines_over_many_partitions(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(2000):04}" for _ in range(1_000_000)]
    parts = spark.sparkContext.parallelize(list(enumerate(words, 1)), 16)
    rows = spark.createDataFrame(parts, "line_no long, line string").repartition(16, "line").cache()
    counts = sorted((w, words.count(w)) for w in sorted(set(words))[:3])
    found = pipes.run_pipe(rows, "sort | uniq -c").orderBy("line_no").collect()
    assert len(found) == len(set(words)) and sum(int(r.line.split()[0]) for r in found) == 1_000_000
    assert [(r.line.split()[1], int(r.line.split()[0])) for r in found[:3]] == counts
    ordered = sorted(words)
    numbered = pipes.run_pipe(rows, "sort | nl").select("line_no", F.split("line", "\t").alias("f"))
    assert numbered.filter(~F.col("f")[0].try_cast("long").eqNullSafe(F.col("line_no"))).isEmpty()
    some = {r.line_no: r.f[1] for r in numbered.filter("line_no % 99991 = 0 OR line_no IN (1, 1000000)").collect()}
    assert some == {n: ordered[n - 1] for n in some} and len(some) == 12
    runs = sum(1 for a, b in zip([None, *words], words) if a != b)
    assert pipes.run_pipe(rows, "uniq | wc -l").first()["line"] == str(runs)
    assert pipes.run_pipe(rows, "nl | tail -n 1").first()["line"] == f"1000000\t{words[-1]}"
    assert pipes.run_pipe(rows, "tail -n +999999 | cut -c 2-").count() == 2


@pytest.mark.parametrize("command", [
    "sort -k 1.2", "sort -M", "sort -h", "sort --parallel=2", "cut -b 1", "cut -d ab -f 1", "cut -f 0", "cut -f 3-1", "cut", "head -z", "head x", "tail -f", "tail -n x", "uniq -f 1", "uniq a b", "grep", "grep -A 1 x", "grep -P x", "grep -q x", "grep a b", "rg --json x", "rg --files", "tr a",
    "tr a-z", "tr '\\n' x", "tr -d '\\n'", "tr z-a x", "tr '[:what:]' x", "nl -w 3", "nl -b p", "cat -A", "cat x", "paste x", "paste -d '\\n' - -", "sed", "wc -L", "wc a b", "sed -s p", "sort -o x", "cat -",
])
def test_what_is_not_implemented_is_rejected(lines, command):
    if command == "cat -":
        assert pipes.run_pipe(lines, command).count() == len(LINES)
        return
    with pytest.raises(workspace.Rejected):
        pipes.run_pipe(lines, command)


@pytest.mark.parametrize("script", ["/a/,/b/d", "s/a/b/2", "s/a/\\n/", "s//x/", "s/a/b", "y/ab/c/", "N;P;D", "a text", "G;p", "dx", "!p", "h", "l", ":x", "b", "{p}", " ; ", "s/a/b/m"])
def test_sed_scripts_that_are_rejected(lines, script):
    with pytest.raises(workspace.UnsafeSed):
        workspace.sed(lines, script)


def test_a_pipe_whose_first_stage_names_files(spark):
    files = spark.createDataFrame([
        ("r", "a.go", "package main\nfunc main() {}\n// TODO: a\n"), ("r", "b.go", "package b\n// TODO: b\n"), ("r", "c.txt", "no todo here\n"), ("r", "src/d.go", "TODO\n"), ("r", "empty", ""),
    ], "repo string, path string, text string")
    run = lambda c: [r.line for r in pipes.run_pipe_on_files(files, c).orderBy("line_no").collect()]
    assert run('rg -l TODO --glob "*.go" | head -1') == ["a.go"]
    assert run("rg ZZZ_NOPE | wc -l") == ["0"]
    assert run("rg TODO") == ["a.go:// TODO: a", "b.go:// TODO: b", "src/d.go:TODO"]
    assert run("rg -n TODO src/ | cut -d : -f 2") == ["1"]
    assert run("rg -c TODO") == ["a.go:1", "b.go:1", "src/d.go:1"]
    assert run("rg -g '!*.go' -i todo") == ["c.txt:no todo here"]
    assert run("cat b.go a.go | head -n 3") == ["package b", "// TODO: b", "package main"]
    assert run("grep -n TODO a.go") == ["3:// TODO: a"]
    assert run("grep -h TODO a.go b.go | sort -r") == ["// TODO: b", "// TODO: a"]
    assert run("sed -n 1p c.txt") == ["no todo here"]
    assert run("wc -l a.go") == ["3"] and run("cat empty") == []
    for bad in ("cat", "head a.go b.go", "tr a b c.txt", "cat a.go | cat b.go"):
        with pytest.raises(workspace.Rejected):
            pipes.run_pipe_on_files(files, bad)


@pytest.mark.parametrize("pattern, extended, expected", [
    ("a+b", False, r"a\+b"), (r"a\+b", False, "a+b"), ("a+b", True, "a+b"), (r"\(a\)\1", False, r"(a)\1"), ("(a)", False, r"\(a\)"), ("*a", False, r"\*a"), ("a^b$c", False, r"a\^b\$c"), ("[\\d]", False, "[\\\\d]"), ("[[:alpha:]_]", False, r"[\p{Alpha}_]"), ("[]a]", False, r"[\]a]"), (r"\<w\>", False, r"\bw\b"), ("a{x", True, r"a\{x"),
])
def test_posix_patterns(pattern, extended, expected):
    assert posix_pattern(pattern, extended) == expected
