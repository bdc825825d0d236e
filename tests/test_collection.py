import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal

import pytest

from folioq.database import Database, collation_of
from folioq.errors import BindFault
from folioq.mapping import Mapper
from folioq.sources import extjson


def test_collection(spark):
    db = Database.memory(spark)
    c = db.collection("c")
    assert c.insert([{"_id": i, "n": i % 3, "v": [float(i), 1.0]} for i in range(9)]) == 9 and c.insert_one({"n": 7}, "INT") == 1
    assert c.find_by_id(4).n == 1 and c.exists(9) and not c.exists(99) and c.count() == 10 and c.count_where("$.n = @n", n=0) == 3
    assert c.min() == 0 and c.max("$.n") == 7 and c.find("$.n > @x", x=1).count() == 4 and c.find_one("$.n = 7")._id == 9 and c.exists_where("$.n = 2")
    assert c.update_many("{n: $.n + @d}", "$._id < 2", d=100) == 2 and c.find_by_id(1).n == 101
    assert c.ensure_index("i", "$.n") and not c.ensure_index("i", "$.n")
    plan = c.query().where("$.n = 5 AND $._id > 3").explain()
    assert plan["index"]["mode"] == "INDEX SEEK(i)" and c.query().where("$._id = 3").explain()["index"]["cost"] == 1
    assert c.ensure_vector_index("near", "$.v", 2, "euclidean")
    assert [r._id for r in c.top_k_near("near", [3.2, 1.0], 2).collect()] == [3, 4]
    assert sorted(r._id for r in c.find_near("near", [3.0, 1.0], 1.0).collect()) == [2, 3, 4]
    with pytest.raises(BindFault):
        c.top_k_near("near", [1.0], 2)
    assert c.upsert([{"_id": 1, "n": 5}, {"_id": 50, "n": 5}]) == (1, 1) and c.update([{"_id": 50, "n": 6}]) == 1 and c.delete([50, 51]) == 1
    assert c.delete_many("$.n = 0") >= 2 and c.rename("d") and c.delete_all() > 0 and c.drop()


def test_collations(spark):
    assert [collation_of(t) for t in ("/Ordinal", "en-US/IgnoreCase", "/OrdinalIgnoreCase", "/IgnoreCase")] == [None, "en_CI", "UTF8_LCASE", "UNICODE_CI"]
    with pytest.raises(BindFault):
        collation_of("en/NumericOrdering")
    df = spark.createDataFrame([(1, "a"), (2, "B"), (3, "A"), (4, "c")], "_id int, s string")
    db = Database(spark, collation="/OrdinalIgnoreCase").attach("t", df)
    assert db.query("t").where("$.s = 'A'").count() == 2 and db.execute("SELECT {k: @key, n: COUNT(*)} FROM t GROUP BY $.s").count() == 3
    assert [r._id for r in db.query("t").order_by("$.s").slice()] == [1, 3, 2, 4]


def test_extended_json(spark):
    x = {"a": 1, "b": extjson.Long(5), "c": Decimal("1.50"), "d": dt.datetime(2020, 1, 2, 3, 4, 5, 678000), "e": b"\x01\x02", "f": [1.5, None, "é\"\n"], "g": {"h": True}}
    assert extjson.decode(extjson.encode(x)) == x
    assert extjson.decode("{a: 1, b: {$numberLong: '7'}}") == {"a": 1, "b": 7}
    df = spark.sql("select 1 a, 5L b, 1.5D c, 'x\"y' d, array(1, 2) e, timestamp'2020-01-02 03:04:05.678' f, true g, named_struct('h', 2L) i")
    assert extjson.encoded(df).first().json == '{"a":1,"b":{"$numberLong":"5"},"c":1.5,"d":"x\\"y","e":[1,2],"f":{"$date":"2020-01-02T03:04:05.678Z"},"g":true,"i":{"h":{"$numberLong":"2"}}}'


@dataclass
class Place:
    city: str = ""


@dataclass
class Town(Place):
    size: int = 0


@dataclass
class Person:
    key: int = field(metadata={"id": True})
    full_name: str = ""
    tags: list[str] = field(default_factory=list, metadata={"omit_empty": True})
    place: Place | None = field(default=None, metadata={"inline": True})
    boss: int | None = field(default=None, metadata={"ref": "people"})
    secret: str = field(default="", metadata={"skip": True})


def test_mapping(spark):
    m = Mapper("camel", {"town": Town})
    assert m.from_document(m.to_document(Town("Bari", 3)), Place) == Town("Bari", 3)
    ann = Person(1, "Ann", ["x"], Place("Rome"), 7, "hidden")
    doc = m.to_document(ann)
    assert doc == {"_id": 1, "fullName": "Ann", "tags": ["x"], "city": "Rome", "boss": {"$id": 7, "$ref": "people"}}
    back = m.from_document(m.frame(spark, [ann]).first(), Person)
    assert (back.key, back.full_name, back.tags, back.place, back.boss, back.secret) == (1, "Ann", ["x"], Place("Rome"), 7, "")
