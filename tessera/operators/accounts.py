"""Users, single-use tokens, API keys, owned sessions and what hangs on a user, as functional merges.

Every function takes tables (see ``tessera.sources.tables``) and gives the table
as it is afterwards; nothing is changed in place.  ``now`` is a timestamp, so that
a rerun gives the same rows.  Small sets of ids are arguments; large ones are
tables and meet the rows in a join.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How long tokens hold, by what they are for.
TOKEN_HOURS = {"verification": 24, "reset": 1}
# What becomes of a user's rows when the user is deleted.
CASCADE, SET_NULL = "cascade", "set null"


def _where(df: DataFrame, hit: Column, **values) -> DataFrame:
    """New values on the rows that ``hit`` holds for."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def point(df: DataFrame, **keys) -> DataFrame:
    """The row with these key values, if there is one; the filter is pushed down to the scan."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df.limit(1)


def exists(df: DataFrame, **keys) -> DataFrame:
    """One row ``found``: whether any row has these values; stops at the first."""
    return point(df, **keys).agg((F.count("*") > 0).alias("found"))


# Users -----------------------------------------------------------------------------


def create_users(users: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """The users with new ones (email, password_hash, display_name, and role if an admin creates them).

    Who registers is a plain user, inactive and not verified; whom an admin
    creates is active and verified, an admin only if that is said, and named by
    the e-mail address if by nothing else.  An address that is taken is an error
    when the result is computed.  Ids go on from the largest.
    """
    by_admin = "role" in new.columns
    name = F.when(F.coalesce("display_name", F.lit("")) == "", F.col("email")).otherwise(F.col("display_name")) if by_admin else F.col("display_name")
    role = F.when(F.col("role") == "admin", "admin").otherwise("user") if by_admin else F.lit("user")
    last = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    rows = new.withColumns({"_name": name, "_role": role, "_n": F.row_number().over(Window.orderBy("email"))}).crossJoin(F.broadcast(last))
    rows = rows.select(
        (F.col("_last") + F.col("_n")).cast("long").alias("id"), "email", "password_hash", F.col("_name").alias("display_name"), F.col("_role").alias("role"),
        F.lit(by_admin).alias("is_active"), F.lit(by_admin).alias("email_verified"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    return unique(users.unionByName(rows.select(*[F.col(c).cast(t) for c, t in users.dtypes])), "email", "the address is taken")


def unique(df: DataFrame, key: str, message: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_ok", F.when(n > 1, F.raise_error(message)).otherwise(F.lit(True)).cast("boolean")).where("_ok").drop("_ok")


def update_user(users: DataFrame, user_id: int, now: datetime, **values) -> DataFrame:
    """New profile, password, role, activity or verification of one user; an address must stay unique.

    Values that are None stay as they were; without any, nothing changes.
    """
    values = {c: v for c, v in values.items() if v is not None}
    if not values:
        return users
    if "role" in values and values["role"] != "admin":
        values["role"] = "user"
    out = _where(users, F.col("id") == user_id, **values, updated_at=now)
    return unique(out, "email", "the address is taken") if "email" in values else out


def seed_admin(users: DataFrame, email: str, password_hash: str, name: str, now: datetime) -> DataFrame:
    """An active, verified admin of this address, with this password, whether there was one or not."""
    there = users.where(F.col("email") == email).limit(1).count() > 0
    if there:
        return _where(users, F.col("email") == email, password_hash=password_hash, role="admin", is_active=True, email_verified=True, updated_at=now)
    new = users.sparkSession.createDataFrame([(email, password_hash, name, "admin")], "email string, password_hash string, display_name string, role string")
    return create_users(users, new, now)


def delete_user(users: DataFrame, user_id: int, owned: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """The tables after a user's deletion: ``users`` and each of owned {name: (table, column, rule)}.

    Rows of a table with the rule ``cascade`` go with their user; with ``set
    null`` they stay without one.
    """
    out = {"users": users.where(F.col("id") != user_id)}
    for name, (df, column, rule) in owned.items():
        own = F.coalesce(F.col(column) == user_id, F.lit(False))
        out[name] = df.where(~own) if rule == CASCADE else _where(df, own, **{column: F.lit(None)})
    return out


def orphans(df: DataFrame, column: str, users: DataFrame, rule: str = CASCADE) -> DataFrame:
    """The same rule for any number of deleted users: rows whose user is gone go, or lose the reference."""
    ids = users.select(F.col("id").alias(column)).distinct()
    if rule == CASCADE:
        return df.join(ids, column, "left_semi").unionByName(df.where(F.col(column).isNull())).select(*df.columns)
    marked = df.join(ids.withColumn("_there", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_there"), F.col(column))).select(*df.columns)


# Tokens ----------------------------------------------------------------------------


def issue_token(tokens: DataFrame, user_id: int, token: str, kind: str, now: datetime) -> DataFrame:
    """The tokens with a new one; a reset token replaces the user's unused ones."""
    if kind == "reset":
        tokens = tokens.where((F.col("user_id") != user_id) | F.col("used_at").isNotNull())
    last = tokens.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    new = last.select("id", F.lit(user_id).cast("long").alias("user_id"), F.lit(token).alias("token"), F.lit(now + timedelta(hours=TOKEN_HOURS[kind])).alias("expires_at"), F.lit(None).cast("timestamp").alias("used_at"), F.lit(now).alias("created_at"))
    return tokens.unionByName(new.select(*[F.col(c).cast(t) for c, t in tokens.dtypes]))


def valid(token: str, now: datetime) -> Column:
    return (F.col("token") == token) & (F.col("expires_at") > F.lit(now)) & F.col("used_at").isNull()


def consume_token(tokens: DataFrame, token: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(the tokens with this one used, the user_id it was for: no row if it was not valid)."""
    hit = valid(token, now)
    return _where(tokens, F.coalesce(hit, F.lit(False)), used_at=now), tokens.where(hit).select("user_id").limit(1)


def verify_email(users: DataFrame, tokens: DataFrame, token: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(users, tokens) after a verification token came back: its user is active and verified."""
    tokens, who = consume_token(tokens, token, now)
    who = who.select(F.col("user_id").alias("id"), F.lit(True).alias("_hit"))
    marked = users.join(F.broadcast(who), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return _where(marked, hit, is_active=True, email_verified=True, updated_at=now).select(*users.columns), tokens


# API keys --------------------------------------------------------------------------


def create_api_key(keys: DataFrame, user_id: int, key: str, key_hash: str, name: str, permissions: list[str], rate_limit: int, now: datetime, expires_at: datetime | None = None) -> DataFrame:
    """The keys with a new one; of the key itself only its first eight characters are kept."""
    last = keys.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    new = last.select(
        "id", F.lit(user_id).alias("user_id"), F.lit(key[:8]).alias("key_prefix"), F.lit(key_hash).alias("key_hash"), F.lit(name).alias("name"), F.array(*map(F.lit, permissions)).cast("array<string>").alias("permissions"),
        F.lit(rate_limit).alias("rate_limit"), F.lit(True).alias("is_active"), F.lit(None).alias("last_used_at"), F.lit(now).alias("created_at"), F.lit(expires_at).alias("expires_at"),
    )
    return keys.unionByName(new.select(*[F.col(c).cast(t) for c, t in keys.dtypes]))


def lookup_api_key(keys: DataFrame, prefix: str, now: datetime) -> DataFrame:
    """The active key of this prefix, unless it has expired."""
    held = F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now))
    return keys.where((F.col("key_prefix") == prefix) & F.col("is_active") & held).select("id", "user_id", "key_hash", "permissions", "rate_limit").limit(1)


def touch_api_key(keys: DataFrame, key_id: int, now: datetime) -> DataFrame:
    return _where(keys, F.col("id") == key_id, last_used_at=now)


def revoke_api_key(keys: DataFrame, key_id: int, user_id: int) -> DataFrame:
    """The key stays, inactive; only its owner can revoke it."""
    return _where(keys, (F.col("id") == key_id) & (F.col("user_id") == user_id), is_active=False)


# Sessions --------------------------------------------------------------------------


def delete_sessions(sessions: DataFrame, ids: DataFrame, user_id: int | None = None) -> DataFrame:
    """Without the sessions named in ids (``id``); with a user_id, only that user's go."""
    gone = sessions.join(ids.select("id").distinct(), "id", "left_semi")
    if user_id is not None:
        gone = gone.where(F.col("user_id") == user_id)
    return sessions.join(gone.select("id").distinct(), "id", "left_anti").select(*sessions.columns)


def rename_session(sessions: DataFrame, session_id, user_id: int, title: str, now: datetime) -> DataFrame:
    return _where(sessions, (F.col("id") == session_id) & (F.col("user_id") == user_id), title=title, updated_at=now)
