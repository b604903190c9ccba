"""License places against brute force over all windows and templates."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import license_scan
from tidemark.llm.license_texts import TEMPLATES

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain(text):
    """Templates of which some stretch of twice their block holds four fifths."""
    held, out = shingles(text), set()
    for name, template in TEMPLATES.items():
        wanted = set(shingles(template))
        block = 1
        while block < 1.25 * len(wanted):
            block *= 2
        for at in range(0, len(held), block):
            if len(wanted & set(held[at:at + 2 * block])) >= 0.8 * len(wanted):
                out.add(name)
    return out


def prose(n, rng):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))


def edited(text, rng, share):
    return " ".join(w + "x" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["", None, "one", prose(3000, rng), "MIT MIT MIT MIT MIT", " ".join(TEMPLATES.values())]
    for name, template in TEMPLATES.items():
        for share in (0, 0.01, 0.03, 0.06):
            out.append(f"{prose(rng.randrange(400), rng)} {edited(template, rng, share)} {prose(rng.randrange(400), rng)}")
        out.append(edited(template, rng, 0.02))
    out.append(prose(20_000, rng) + " " + TEMPLATES["BSD-3-Clause"] + " " + prose(20_000, rng))
    return out


@pytest.mark.parametrize("chunk", [1, 3000, 1 << 18])
def test_places_equal_brute_force(texts, monkeypatch, chunk):
    monkeypatch.setattr(license_scan, "CHUNK", chunk)
    got = {}
    for n, name, first, words, share in license_scan.Scanner(TEMPLATES).scan(texts):
        got.setdefault(n, set()).add(name)
        place = set(shingles(" ".join(re.findall(r"\w+", texts[n].lower())[first:first + words])))
        wanted = set(shingles(TEMPLATES[name]))
        assert share >= 0.8 and len(place & wanted) / len(wanted) >= share - 1e-9
    want = {n: plain(t) for n, t in enumerate(texts) if t and plain(t)}
    assert len(want) > 3 * len(TEMPLATES)
    assert got == want


def test_every_template_finds_itself():
    found = {}
    for n, name, *_, share in license_scan.Scanner(TEMPLATES).scan(TEMPLATES.values()):
        found.setdefault(n, {})[name] = share
    assert [found[n][name] for n, name in enumerate(TEMPLATES)] == [1.0] * len(TEMPLATES)


def test_bands_reach_the_stated_probability():
    """Pairs of the least similarity that bands are set for collide all but always."""
    assert (1 - 0.2) ** license_scan.bands_needed(0.2) <= license_scan.MISS
    rng, missed = np.random.default_rng(2), 0
    for _ in range(300):
        template = " ".join(f"w{x}" for x in rng.integers(0, 10 ** 9, 40))
        words = template.split()
        words[int(rng.integers(4, 36))] = "other"  # five of 36 shingles go
        scanner = license_scan.Scanner({"t": template}, seed=int(rng.integers(1 << 30)))
        filler = " ".join(f"v{x}" for x in rng.integers(0, 10 ** 9, 300))
        missed += not list(scanner.scan([f"{filler} {' '.join(words)} {filler}"]))
    assert missed == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(7, TEMPLATES["MIT"], "t", 1, 2), (7, TEMPLATES["MIT"], "t", 1, 2), (None, TEMPLATES["Zlib"], None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, template string, id int, words int")
    got = sorted((str(r.doc_id), r.template) for r in license_scan.scan_licenses(df).collect())
    assert got == [("7", "MIT")] * 2 + [("7", "MIT notice")] * 2 + [("None", "Zlib")]
