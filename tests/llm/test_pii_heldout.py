"""Personal data in sentences that training never sees. The bounds are what the stored weights reach, rounded down."""

from collections import Counter

from tests.llm.heldout import cases
from tidewatch.llm import pii

RECALL = {"email": 0.9, "phone": 0.85, "id_number": 0.9, "street_address": 0.8, "name": 0.7}
PRECISION = {"email": 0.9, "phone": 0.9, "id_number": 0.85, "street_address": 0.8, "name": 0.7}


def test_unseen_sentences():
    texts = cases()
    made, real, hit = Counter(), Counter(), Counter()
    for (text, want), spans in zip(texts, pii.spans_of([t for t, _ in texts])):
        got = {(k, text[a:b]) for a, b, k in spans}
        made.update(k for k, _ in got)
        real.update(k for k, _ in want)
        hit.update(k for k, _ in got & want)
    for kind in pii.KINDS:
        assert hit[kind] / real[kind] >= RECALL[kind], kind
        assert hit[kind] / made[kind] >= PRECISION[kind], kind


def test_titles_are_no_part_and_short_or_capital_names_may_be_found():
    for found, want in (("M. Olivier", "Olivier"), ("Dr Li", "Li"), ("SMITH", "SMITH")):
        a, b = pii._name(f"Seen: {found}.", 6, 6 + len(found))
        assert f"Seen: {found}."[a:b] == want
