import hashlib
import random
import re
import string

from llm_helpers import same
from skyquilt.llm import line_chunks as L
from skyquilt.llm import secrets as S


def chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:6], 16) for x in lines]
    out, part = [], []
    for i, x in enumerate(lines):
        part.append(x)
        rolled = ((h[i - 1] if i else 0) * L.ROLL + h[i]) % L.MODULUS
        if rolled % L.MEAN_LINES == 0 or i == len(lines) - 1 or max(len(x), len(lines[i + 1])) >= L.LONG_CHARS:
            out.append(part)
            part = []
    return out


def brute(rows):
    first = {}
    cut = [chunks(t) for _, t in rows]
    for (doc, _), parts in zip(rows, cut, strict=True):
        for k, p in enumerate(parts):
            if (len(p) >= 2 or len(p[0]) >= L.LONG_CHARS) and len("\n".join(p)) >= L.MIN_CHARS:
                at = (-(2**63) if doc is None else doc, k)
                first[tuple(p)] = min(first.get(tuple(p), at), at)
    out = []
    for (doc, text), parts in zip(rows, cut, strict=True):
        gone = [tuple(p) in first and first[tuple(p)] != (-(2**63) if doc is None else doc, k) for k, p in enumerate(parts)]
        kept = [x for p, g in zip(parts, gone, strict=True) if not g for x in p]
        out.append((doc, text if not any(gone) else "\n".join(kept), sum(map(len, parts)), sum(gone), sum(len(p) for p, g in zip(parts, gone, strict=True) if g)))
    return out


def test_lines_against_brute_force(spark, corpus, nothing):
    rng = random.Random(2)
    shared = [f"shared line {i} of some length" for i in range(20)]
    rows = list(corpus) + [(100 + i, "\n".join([f"own {i} {rng.random()}" for _ in range(rng.randint(0, 5))] + shared + [f"tail {i}"])) for i in range(6)] + [(200, "\n".join(shared + shared)), (201, "a\n\n\n\nb"), (None, "\n".join(shared))]
    got = L.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert sum(w[3] for w in want) > 8
    same(got.select("doc_id", "text", "n_lines", "n_removed_chunks", "n_removed_lines").collect(), want)
    assert L.remove_repeated_chunks(nothing).count() == 0


def test_passages_of_long_lines_are_caught_whole(spark):
    """Passages of over 50 words, in one line or three, go from all documents but the first; what is around them stays."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(55)], [line(25), line(20), line(22)]]
    rows = [(i, "\n".join([line(rng.randint(1, 30)) for _ in range(2)] + passages[i % 2] + [line(4)])) for i in range(12)]
    got = {r.doc_id: r.text for r in L.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert got[i].split("\n") == (lines if i < 2 else lines[:2] + lines[-1:])


def test_extra_columns_stay(docs):
    clash = docs.withColumnRenamed("score", "n_lines")
    got = L.remove_repeated_chunks(clash)
    assert set(clash.columns) <= set(got.columns) and got.columns.count("n_lines") == 1 and got.count() == docs.count()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    said = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return *(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(said.encode()).hexdigest()


def test_secrets_against_brute_force(spark, corpus):
    key = "AKIA" + "Q7" * 8
    rows = list(corpus) + [(100, f"é😀 Password = 'abc' token=secret:abcdefgh api_key:\"{key}\" x"), (101, "TOKEN=\n" + "0123456789abcdef" * 3), (102, key + " " + "f" * 31), (103, "secret=" + "a" * 5000), (104, "apikey = aaaa.bbbb=passwd:cccccccc"), (105, "AKIAAKIA" + "A" * 12)]
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect(), [(d, *base(t)) for d, t in rows])


def test_battery_tells_keys_from_text(spark, nothing):
    rng = random.Random(3)
    text = ["thenthisisawordthatgoesonandon", "a" * 32, "hello-world-this-is-a-slug-of-words", "internationalizationandlocalization", "0101010101010101010101010101010101"]
    made = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40)) for _ in range(50)]
    rows = [(i, f"é {x} .") for i, x in enumerate(text * 3 + made)]
    got = {r.doc_id: r.spans for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("random" in got[i] for i in range(15)) and sum(got[i] == "random:2:42" for i in range(15, 65)) >= 45
    assert S.find_secrets(nothing).count() == 0


def test_keys_inside_assignments_and_paths(spark):
    """Names before "=" and folders before a key do not hide it."""
    rng = random.Random(8)
    key = lambda n, extra="": "".join(rng.choice(string.ascii_letters + string.digits + extra) for _ in range(n))
    rows = [(i, f) for i in range(40) for f in (f"AWS_KEY={key(40)} x", f"see https://host.example/my-path/{key(44)} now", f"u?sig={key(43, '-_')}&v=1")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.spans for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [sum("random:" in got[i] for i in range(k, 120, 3)) for k in range(3)]
    assert min(found) >= 15, found  # few strings in a stratum: about half are reported


def test_false_discoveries_stay_below_the_limit(spark):
    """Planted keys among text that looks like keys: the share of text among what is reported, and the share of keys found."""
    rng = random.Random(9)
    syllables = "an be co du el fi go ha in jo ka lu me no op pe qu ra su ti un ve wo xi yo".split()
    keys = ["".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(rng.randint(24, 60))) for _ in range(400)]
    text = ["".join(rng.choice(syllables) for _ in range(rng.randint(12, 30))) for _ in range(400)]
    rows = list(enumerate(keys + text))
    got = {r.doc_id: "random:" in r.spans for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught, false = sum(got[i] for i in range(400)), sum(got[i] for i in range(400, 800))
    print("keys found", caught, "of 400; text among what is reported", false, "of", caught + false)
    assert caught >= 190 and false <= 0.05 * (caught + false)


def test_positions_beyond_one_block(spark):
    """More matches in a text than are numbered at once."""
    text = " ".join(f"é token={i:010d}" for i in range(300))
    got = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_assign, got.n_access, got.n_hex, got.base_sha256) == base(text)
