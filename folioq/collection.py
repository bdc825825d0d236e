"""A collection by name: what can be done with it, in one place."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row

from .plans.query import Query
from .streaming import ttl

if TYPE_CHECKING:
    import datetime as dt

    from .database import Database


class Collection:
    def __init__(self, database: Database, name: str) -> None:
        self.database, self.name = database, name

    def query(self) -> Query:
        return self.database.query(self.name)

    def frame(self) -> DataFrame:
        return self.query().frame()

    # Reading

    def find_by_id(self, key: Any) -> Row | None:
        return self.query().where("$._id = @key").param("key", key).first_or_default()

    def exists(self, key: Any) -> bool:
        return self.find_by_id(key) is not None

    def _where(self, test: str, params: dict[str, Any]) -> Query:
        q = self.query().where(test)
        for k, v in params.items():
            q = q.param(k, v)
        return q

    def find(self, test: str, **params: Any) -> DataFrame:
        return self._where(test, params).frame()

    def find_one(self, test: str, **params: Any) -> Row | None:
        return self._where(test, params).first_or_default()

    def find_all(self) -> list[Row]:
        return self.query().slice()

    def all(self) -> Iterator[Row]:
        return self.query().all()

    def count(self) -> int:
        return self.query().count()

    def count_where(self, test: str, **params: Any) -> int:
        return self._where(test, params).count()

    def exists_where(self, test: str, **params: Any) -> bool:
        return self._where(test, params).exists()

    def min(self, key: str = "$._id") -> Any:
        return self.query().min(key)

    def max(self, key: str = "$._id") -> Any:
        return self.query().max(key)

    # Writing

    def insert(self, docs: DataFrame | list[dict[str, Any]], auto_id: str = "OBJECTID") -> int:
        return self.database.insert(self.name, docs, auto_id)

    insert_bulk = insert

    def insert_one(self, doc: dict[str, Any], auto_id: str = "OBJECTID") -> int:
        return self.insert([doc], auto_id)

    def update(self, docs: DataFrame | list[dict[str, Any]]) -> int:
        return self.database.update(self.name, docs)

    def upsert(self, docs: DataFrame | list[dict[str, Any]]) -> tuple[int, int]:
        return self.database.upsert(self.name, docs)

    def update_many(self, changes: str, where: str | None = None, **params: Any) -> int:
        return self.database.update_many(self.name, changes, where, params)

    def delete(self, ids: list[Any]) -> int:
        return self.database.delete(self.name, ids)

    def delete_many(self, where: str, **params: Any) -> int:
        return self.database.delete_many(self.name, where, params)

    def delete_all(self) -> int:
        return self.database.delete_many(self.name)

    def expire(self, expr: str, now: dt.datetime | None = None) -> int:
        return ttl.sweep(self.database, self.name, expr, now)

    # Definitions

    def ensure_index(self, name: str, expr: str, unique: bool = False) -> bool:
        return self.database.ensure_index(self.name, name, expr, unique)

    def drop_index(self, name: str) -> bool:
        return self.database.drop_index(self.name, name)

    def ensure_vector_index(self, name: str, field: str, dims: int, metric: str = "cosine") -> bool:
        return self.database.ensure_vector_index(self.name, name, field, dims, metric)

    def top_k_near(self, index: str, target: list[float], k: int) -> DataFrame:
        return self.database.search_index(self.name, index, target, k=k)

    def find_near(self, index: str, target: list[float], most: float) -> DataFrame:
        return self.database.search_index(self.name, index, target, most=most)

    def drop(self) -> bool:
        return self.database.drop(self.name)

    def rename(self, name: str) -> bool:
        done = self.database.rename(self.name, name)
        self.name = name if done else self.name
        return done
