"""Small tables with every awkward case, and brute-force forms."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, n int, cluster string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = {c: c + 32 for c in range(65, 91)}
LINE = "This Line Stands In Very Many Of The Documents Here"


def words(text):
    return WORD.findall((text or "").translate(_LOW))


def rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    out = []
    for i in range(24):
        text = " ".join(base[i % 5 :] + [f"w{i % 7}"] + base)
        out.append((i, text + ("\n" + LINE if i % 3 else "\n  " + LINE.upper() + "\t"), "en" if i % 2 else "de", f"src{i % 4}", len(text), "x", 1, "c"))
    out.append((30, None, None, None, None, None, None, None))
    out.append((31, "", "en", "src0", 0, None, None, None))
    out.append((32, " \t\n\x0b ", "en", None, 5, None, None, None))
    out.append((33, "One", "en", "src1", 3, None, None, None))
    out.append((34, "one Two", "en", "src1", 7, None, None, None))
    out.append((35, "1234 5678 --", "en", "src1", 12, None, None, None))
    out.append((36, "long " + "x" * 70_000 + " tail " + " ".join(f"t{i}" for i in range(5000)), "en", "src1", 1, None, None, None))
    out.append((36, "a repeated id with another text", "en", "src1", 1, None, None, None))
    out += [out[3]] * 3
    out.append((None, base[0] + " without an id", "en", "src2", 1, None, None, None))
    out.append((None, base[0] + " without an id", "en", "src2", 1, None, None, None))
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
