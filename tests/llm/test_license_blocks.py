"""Notices that are wrapped, commented or have CRLF lines, and all runs of lines by brute force."""

import random
import textwrap

import pytest

from docketry.llm import license_scan
from docketry.llm.decontamination import words

LONG = [(label, text) for label, text in license_scan.TEMPLATES if len(words(text)) > 12]


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
@pytest.mark.parametrize("width", [25, 70, 140])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_wrapped_notices(mark, width, end):
    templates = license_scan.Templates({})
    for label, text in LONG:
        body = end.join([mark + "Copyright", mark.rstrip(), *(mark + x for x in textwrap.wrap(text, width)), mark.rstrip(), "int main() {", "}"])
        assert (label, 1.0) in {(name, share) for name, _, share in license_scan.blocks_of(body, templates)}, (label, mark, width)


def test_all_runs_of_lines():
    """Every run of lines that holds a template and no shorter one is found, and nothing else."""
    rng = random.Random(4)
    templates = license_scan.Templates({})
    for _ in range(40):
        lines = [rng.choice(["", "x y z", *textwrap.wrap(rng.choice(LONG)[1], rng.choice([20, 40, 80]))]) for _ in range(3)]
        for _ in range(2):
            lines += textwrap.wrap(rng.choice(license_scan.TEMPLATES)[1], rng.choice([20, 40, 80])) + ["int f;"] * rng.randint(0, 2)
        sets = [set(words(x)) for x in lines]
        for (_, tokens), needed in zip(templates.sets, templates.needed, strict=True):
            shared = [x & set(tokens) for x in sets]
            runs = [(i, j) for i in range(len(sets)) for j in range(i, len(sets)) if len(set().union(*shared[i:j + 1])) >= needed]
            least = [(i, j) for i, j in runs if not any(x >= i and y <= j and (x, y) != (i, j) for x, y in runs)]
            want = [(i, j) for i, j in least if i == j or len(set().union(*sets[i:j + 1])) <= license_scan.SLACK * len(tokens)]
            assert sorted(license_scan.shortest_runs(sets, shared, len(tokens), needed)) == want
