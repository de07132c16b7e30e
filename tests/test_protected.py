"""Protected areas from relations to features, ring assembly in linear time, and sets of outputs that are published as one."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from emberlens.operators import geometry, protected, spatial
from emberlens.sources import sinks
from tests.test_operators import RINGS, square


def way(*points, role="outer"):
    return {"type": "way", "role": role, "geometry": [{"lat": y, "lon": x} for x, y in points]}


def relation(i, *members, **tags):
    return {"type": "relation", "id": i, "tags": {"name": "Заповедник", **tags}, "members": list(members)}


BOX = ((100.0, 52.0), (100.2, 52.0), (100.2, 52.1), (100.0, 52.1), (100.0, 52.0))


def test_rings_from_many_ways_take_linear_time():
    def closed(n):
        spots = [(float(i), float(i % 2)) for i in range(n)]
        ways = [[spots[i], spots[(i + 1) % n]][:: 1 if i % 3 else -1] for i in range(n)]
        random.Random(1).shuffle(ways)
        t = time.perf_counter()
        rings = geometry._join_ways(ways)
        assert [len(r) for r in rings] == [n + 1]
        return time.perf_counter() - t

    closed(1000)
    assert closed(20_000) < 2


def test_rings_go_on_with_the_first_way_left():
    a, b, c, d = (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)
    assert geometry._join_ways([[a, b], [b, d, a], [b, c], [c, a]]) == [[a, b, d, a]]  # the way from b that stands first; b c a is left open
    assert geometry._join_ways([[a, b, c, a], [c, d], [d, c], [a]]) == [[a, b, c, a]]
    assert geometry._join_ways([[a, b], [c, d]]) == []


def test_answers(spark):
    bodies = [None, " ", "<html>", '{"elements": [', "[1]", '{"remark": "x"}', '{"elements": [], "remark": "runtime Error: timed out"}', '{"elements": [], "remark": "note"}']
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, b string").select("i", protected.answer_problem(F.col("b")).alias("p")).collect()
    assert [r.p for r in sorted(got)] == ["empty", "empty", "a page instead of data", "no whole object", "no whole object", "no elements", "partial, with an error", None]


def test_features(spark):
    hole = ((100.12, 52.03), (100.16, 52.03), (100.16, 52.07), (100.12, 52.07), (100.12, 52.03))
    elements = [
        relation(1, way(*BOX[:3]), way(*BOX[:1:-1]), **{"area:ha": "7"}), relation(2, way(*BOX), way(*hole, role="inner")), relation(3, way(*BOX[:3])), relation(4, way((100.0, 52.0), (100.0, 52.1), (100.0, 52.2), (100.0, 52.0))),
        relation(5), relation(6, way(*BOX), name="Reserve", **{"name:ru": "Парк"}), relation(7, way(*BOX), name="ნაკრძალი"), relation(8, way(*[(x + 40, y) for x, y in BOX])), {"type": "node", "id": 9}, {"type": "relation", "id": 10, "members": []},
        relation(11, way((100.1, 95.0), (100.2, 95.0))), relation(12, way(*BOX), way((1.0, 1.0))),
    ]
    answers = spark.createDataFrame([(json.dumps({"elements": elements}),), (json.dumps({"elements": [relation(99, way(*BOX))], "remark": "error"}),)], "value string")
    regions = spatial.edges_of(spark.createDataFrame([("A", 0, [[square(99.0, 51.0, 3.0)]])], RINGS))
    found, rings, bad = protected.features(protected.relations(answers), regions)
    got = {r.id: r for r in found.collect()}
    assert set(got) == {1, 2, 3, 6, 12} and {r.id: r.problem for r in bad.collect()} == {4: "zero area", 11: "off the globe"}
    assert (got[1].kind, got[1].area_ha, got[1].lat, got[1].lon) == ("polygon", 7.0, pytest.approx(52.05), pytest.approx(100.1))
    assert (got[3].kind, got[3].area_ha) == ("point", None) and got[3].lon == pytest.approx(400.4 / 3 - 100 / 3, abs=1e-6)
    whole = got[12].area_ha
    assert whole == pytest.approx(0.2 * 111.32 * 0.6147 * 0.1 * 111.32 * 100, rel=0.02) and got[2].area_ha == pytest.approx(whole * 0.92, rel=0.01) and got[6].name == "Парк"
    assert got[2].lon == pytest.approx(100.06)  # the widest stretch beside the hole
    assert {r.id: r.n for r in rings.groupBy("id").agg(F.count("*").alias("n")).collect()}[2] == 2
    verdict = lambda last: protected.list_verdict(found, bad, last, least=3).first()
    assert (verdict(None).kept, verdict(None).dropped, verdict(None).problem) == (5, 2, None) and verdict(11).problem == "fewer than half of the last"
    assert protected.list_verdict(found, bad, None).first().problem == "too few"


def test_a_set_is_published_as_one(spark, tmp_path):
    sets = sinks.PublishedSets(spark, str(tmp_path / "sets"))
    assert sets.published() == {}
    count = lambda: {n: df.count() for n, df in sets.published().items()}
    assert sets.publish({"archive": spark.range(3), "cells": spark.range(2)}) == []
    assert count() == {"archive": 3, "cells": 2}
    short = lambda out: [] if out["archive"].count() >= 3 else ["archive: regions missing"]
    assert sets.publish({"archive": spark.range(1), "cells": spark.range(9)}, short) == ["archive: regions missing"] and count() == {"archive": 3, "cells": 2}
    assert "over 10" in sets.publish({"archive": spark.range(5), "cells": spark.range(9)}, most_bytes={"cells": 10})[0] and count() == {"archive": 3, "cells": 2}
    dies = spark.range(3).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        sets.publish({"archive": spark.range(7), "cells": dies})
    assert count() == {"archive": 3, "cells": 2}
    assert sets.publish({"archive": spark.range(8), "cells": spark.range(1)}, short) == [] and count() == {"archive": 8, "cells": 1}
