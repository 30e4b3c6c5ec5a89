"""JSON graphs are imported whole or not at all."""

import json

import pytest

from graphweft.sources import graphfiles


@pytest.mark.parametrize(("types", "message"), [([f"T{i}" for i in range(1001)], "1,000 relationship types"), (["A", None], "without type")])
def test_relationships_that_cannot_be_imported_raise(spark, tmp_path, types, message):
    rels = [{"id": i, "startNode": 1, "endNode": 1, "type": t} for i, t in enumerate(types)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1, "labels": ["N"], "properties": {"a": 1}}], "relationships": rels}))
    with pytest.raises(ValueError, match=message):
        graphfiles.import_json(spark, str(tmp_path / "g.json"))
