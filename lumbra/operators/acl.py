"""Access control lists: doc_id, owner, readers, writers, public, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in(users: str, user: Column) -> Column:
    return F.coalesce(F.array_contains(F.col(users), user), F.lit(False))


def is_owner(user: Column) -> Column:
    return F.coalesce(F.col("owner") == user, F.lit(False))


def can_read(user: Column) -> Column:
    """Public, or the user owns, reads or writes it. Groups aren't looked at."""
    return F.coalesce(F.col("public"), F.lit(False)) | is_owner(user) | _in("readers", user) | _in("writers", user)


def can_write(user: Column) -> Column:
    return is_owner(user) | _in("writers", user)


def filter_documents(acl: DataFrame, wanted: DataFrame, user: str) -> DataFrame:
    """The wanted rows (ord, doc_id) that the user may read, in their order; documents without a list aren't readable."""
    return wanted.join(acl.filter(can_read(F.lit(user))).select("doc_id"), "doc_id", "left_semi")


def list_documents(acl: DataFrame, user: str) -> DataFrame:
    """Documents that a user's list shows: own, public or with the user among the readers. Writers see only those by name in the others."""
    u = F.lit(user)
    return acl.filter(is_owner(u) | F.coalesce(F.col("public"), F.lit(False)) | _in("readers", u)).select("doc_id")


def _change(acl: DataFrame, doc_id: str, **columns: Column) -> DataFrame:
    here = F.col("doc_id") == doc_id
    return acl.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in columns.items()})


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def grant(acl: DataFrame, doc_id: str, user: str, write: bool = False) -> DataFrame:
    c = "writers" if write else "readers"
    return _change(acl, doc_id, **{c: F.array_union(_list(c), F.array(F.lit(user)))})


def revoke(acl: DataFrame, doc_id: str, user: str) -> DataFrame:
    return _change(acl, doc_id, readers=F.array_remove(_list("readers"), user), writers=F.array_remove(_list("writers"), user))


def set_public(acl: DataFrame, doc_id: str, public: bool) -> DataFrame:
    return _change(acl, doc_id, public=F.lit(public))


def create(acl: DataFrame, doc_id: str, owner: str) -> DataFrame:
    """A new private list for the document in place of any old one."""
    row = acl.sparkSession.createDataFrame([(doc_id, owner, [], [], False, [])], "doc_id string, owner string, readers array<string>, writers array<string>, public boolean, groups array<string>")
    return delete(acl, doc_id).unionByName(row)


def delete(acl: DataFrame, doc_id: str) -> DataFrame:
    return acl.filter(~F.col("doc_id").eqNullSafe(doc_id))
