import random
import re

import pytest

from tallyloom.llm import licenses

SCHEMA = "doc_id long, text string, s string, labels int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def pattern(template):
    """A template as a regular expression over words that each have a space before them."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(re.sub(r"(<<[^>]*>>)", r" \1 ", template))):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<</optional>>":
            out += ")?"
        elif part.startswith("<<var"):
            least, most = part[5:-2].split()
            out += f"(?: [^ ]+){{{least},{most}}}"
        else:
            out += " " + re.escape(part)
    return out + "(?= |$)"


def plain(text):
    w = words(text)
    base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels = {label for _, label in base} | {label for label, t in licenses.TEMPLATES.items() if re.search(pattern(t), "".join(f" {x}" for x in w))}
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_against_brute_force(spark):
    rng = random.Random(11)
    pieces = [*licenses.PHRASES, "licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC-SA 4.0", "released under the MIT License", "is licensed under the GNU General Public License, either version 3", "mit mit license license", "gnu general public gnu general public license",
              "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"]
    pieces += re.findall(r"\w+", " ".join(pieces))
    texts = [None, "", "...", "MIT License", "cc by cc by", "x" * 200_000]
    texts += [rng.choice([" ", "\n", ", "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    out = sorted(licenses.license_scan(spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)).collect())
    assert [tuple(r)[1:7] for r in out] == [plain(t) for t in texts]
    assert all(0 <= r.score <= 1 for r in out)


def filled(template, rng, optional):
    """A text of the template: every optional region or none, and as few or as many words for each replaceable one."""
    out, keep = [], [True]
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            keep.append(keep[-1] and optional)
        elif part == "<</optional>>":
            keep.pop()
        elif part.startswith("<<var"):
            least, most = map(int, part[5:-2].split())
            out += [f"Name{i}" for i in range(rng.choice([least, most]))] if keep[-1] else []
        elif keep[-1]:
            out.append(part)
    return " ".join(out)


def test_whole_licenses_are_found_and_changed_ones_are_not(spark):
    """Every template in both forms, in comment marks and other cases; one changed mandatory word, and it is gone."""
    rng = random.Random(2)
    texts, truth = [], []
    for label, template in licenses.TEMPLATES.items():
        for optional in (False, True):
            text = filled(template, rng, optional)
            lines = re.sub(r"\s*\n\s*", "\n * ", text)
            lead = words(re.split(r"<<", template)[0])
            for t in (text, "/*" + lines.upper() + "*/ int main() {}", "before " * 50 + text + " after " * 50):
                texts.append(t)
                truth.append((label, True))
            texts.append(re.sub(rf"(?i)\b{lead[-1]}\b", "otherwise", text, count=1))
            truth.append((label, False))
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    out = {r.id: r for r in licenses.license_scan(frame).collect()}
    assert [(label, label in out[i].labels.split(",")) for i, (label, _) in enumerate(truth)] == truth
    assert [tuple(out[i])[1:7] for i in range(len(texts))] == [plain(t) for t in texts]


def test_gnu_headers_are_told_apart():
    automata = {label: licenses.Automaton(t) for label, t in licenses.TEMPLATES.items()}
    for label, name in (("gpl-header", "General"), ("lgpl-header", "Lesser General"), ("agpl-header", "Affero General")):
        text = filled(licenses.TEMPLATES[label], random.Random(4), True)
        assert f"GNU\n        {name} Public" in text
        assert {x for x in licenses.scan(text, automata)[5].split(",") if x.endswith("-header")} == {label}
    mixed = filled(licenses.TEMPLATES["lgpl-header"], random.Random(4), True).replace("Lesser ", "", 1)
    assert not any(x.endswith("-header") for x in licenses.scan(mixed, automata)[5].split(","))


def test_optional_and_replaceable_regions():
    a = licenses.Automaton("start here <<optional>> maybe <<var 1 2>> <</optional>> end <<var 0 1>>")
    run = lambda s: a.accepts(s.encode().split(), 0)
    assert [run(s) for s in ("start here end", "start here maybe x end", "start here maybe x y end z", "start here maybe end end", "start here maybe x y z end", "start there end")] == [3, 5, 7, 5, 0, 0]
    for bad in ("<<optional>> a <</optional>>", "a <<optional>> b", "a <<what>>", "a <</optional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def test_repeats_nulls_and_empty(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    out = licenses.license_scan(spark.createDataFrame([(None, "mit license", "", 0), (1, None, "", 0), (1, None, "", 0)], SCHEMA)).collect()
    assert sorted((str(r.id), r.n_words, r.n_base, r.first_word) for r in out) == [("1", 0, 0, None), ("1", 0, 0, None), ("None", 2, 1, 0)]
