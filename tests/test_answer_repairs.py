import json

import pytest

from tessella.operators import model
from tessella.plans.pipeline import Corpus


class Many(model.OfflineClient):
    """130 facts of a chunk in a reply that only the model itself can repair."""

    def __init__(self, reduced, repaired):
        self.reduced, self.repaired = reduced, repaired

    def complete(self, kind, prompt, max_tokens):
        if kind == "extract":
            number = prompt.split("<<chunk ")[1].partition(">>")[0]
            return f"facts of {number}:"
        if kind == "repair_facts":
            number = int(prompt.removeprefix("facts of ").removesuffix(":"))
            return json.dumps({"facts": [{"chunk_id": number, "statement": f"s{k}", "object": f"o{k}", "confidence": "high" if k == 129 else "low"} for k in range(130)]})
        if kind == "reduce":
            return self.reduced
        if kind == "repair_indexes":
            return self.repaired
        return super().complete(kind, prompt, max_tokens)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repairs")
    (root / "src").mkdir()
    (root / "src" / "a.txt").write_text("The allowance is paid each month.\n")
    c = Corpus(spark, f"file://{root}/store")
    c.index_folder(f"{root}/src")
    return c


@pytest.mark.parametrize(("reduced", "repaired", "want"), [('{"keep_indexes": [130, 2, 2]}', "", ["s1", "s129"]), ("1 and 3", 'so: {"keep_indexes": [1, 3]}', ["s0", "s2"]), ("?", "?", None), ('{"keep_indexes": []}', '{"keep_indexes": [1]}', None)])
def test_the_model_repairs_and_reduces(corpus, reduced, repaired, want):
    got = [f["statement"] for f in corpus.answer("What is the allowance?", client=Many(reduced, repaired)).facts]
    assert got == ([*[f"s{k}" for k in range(119)], "s129"] if want is None else want)
