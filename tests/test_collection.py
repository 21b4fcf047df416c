"""Collections of objects: writing, asking, joining."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tessera.collection import Collection
from tessera.operators import predicates as P


@dataclasses.dataclass(frozen=True)
class Car:
    car_id: int
    maker: str | None
    price: float | None


@dataclasses.dataclass(frozen=True)
class Owner:
    owner_id: int
    name: str


@dataclasses.dataclass(frozen=True)
class Vehicle:
    vehicle_id: int
    owner_id: int | None


CARS = [Car(i, ["Ford", "BMW", None][i % 3], i * 1.5 if i % 4 else None) for i in range(20)]


def test_collection(spark, store):
    c = Collection(store, "cars", Car).create()
    c.add_all(CARS)
    assert len(c) == 20 and c.get(3) == CARS[3] and CARS[5] in c and Car(5, "x", 0.0) not in c and c.get(99) is None
    ford = P.Equal("maker", "Ford")
    assert set(c.retrieve(~ford & P.Has("price"))) == {x for x in CARS if x.maker != "Ford" and x.price is not None}
    assert c.retrieve(ford, [F.col("price").desc_nulls_last()], 2) == sorted((x for x in CARS if x.maker == "Ford" and x.price), key=lambda x: -x.price)[:2]
    assert c.statistics("maker") == [("BMW", 7), ("Ford", 7)] and c.count(ford) == 7
    assert [x.car_id for x in c.read_page(None, 3)] == [0, 1, 2] and [x.car_id for x in c.read_page(17, 5)] == [18, 19]
    c.add(Car(0, "new", 1.0))
    c.update([CARS[1]], [Car(2, "two", 2.0), Car(100, None, None)])
    assert len(c) == 20 and c.get(1) is None and c.get(0).maker == "new" and c.get(2).maker == "two"
    c.remove_all([CARS[3], CARS[4]])
    c.optimize("price")
    assert len(list(c.stream(P.Has("price")))) == sum(1 for x in c.retrieve() if x.price is not None)
    with c.bulk_writer(chunk=2) as w:
        w.add_all(c.layout.row(x) for x in CARS[:5])
    assert c.get(1) == CARS[1] and c.register().count() == spark.sql("select count(*) from cars").first()[0]
    c.clear()
    assert len(c) == 0 and c.describe().startswith("cars(car_id long")


def test_pairs(spark, store):
    owners, vehicles = Collection(store, "owners", Owner).create(), Collection(store, "vehicles", Vehicle).create()
    owners.add_all([Owner(1, "a"), Owner(2, "b"), Owner(3, "c")])
    vehicles.add_all([Vehicle(10, 1), Vehicle(11, 1), Vehicle(12, 2), Vehicle(13, None), Vehicle(14, 9)])
    got = set(vehicles.pairs(owners, "owner_id", "owner_id"))
    assert got == {(Vehicle(10, 1), Owner(1, "a")), (Vehicle(11, 1), Owner(1, "a")), (Vehicle(12, 2), Owner(2, "b"))}
    assert set(vehicles.pairs(owners, "owner_id", "owner_id", P.GreaterThan("vehicle_id", 10), P.Equal("name", "a"))) == {(Vehicle(11, 1), Owner(1, "a"))}
    with_car = P.ExistsIn(vehicles.df(), "owner_id", "owner_id")
    assert {o.name for o in owners.retrieve(with_car)} == {"a", "b"} and {o.name for o in owners.retrieve(~with_car)} == {"c"}


def test_keys_are_one_per_object(store):
    c = Collection(store, "cars", Car).create()
    c.add_all([Car(1, "a", 1.0), Car(1, "b", 2.0)])
    assert c.retrieve() == [Car(1, "b", 2.0)]
    with pytest.raises(Exception):
        with c.bulk_writer(new_keys=True) as w:
            w.add(1, "c", 3.0)
