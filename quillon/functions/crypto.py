"""Field encryption: AES-256-CBC with a key derived once on the driver."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 600_000
SALT_BYTES = 16


def derive_key(passphrase: str, salt: bytes) -> bytes:
    """One derivation for both directions."""
    if len(salt) < SALT_BYTES:
        raise ValueError(f"salt must have at least {SALT_BYTES} bytes")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ROUNDS, dklen=32)


def store_key(spark: SparkSession, key: bytes, path: str) -> None:
    """Write a key as the one file of a folder, for :func:`stored_key`. Who may read the folder may decrypt."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/key.txt")
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, False)
    try:
        out.write(bytearray(base64.b64encode(key)))
    finally:
        out.close()


def stored_key(spark: SparkSession, path: str) -> Column:
    """The key of a folder. Executors read it when a query runs, so plans, event logs and web pages hold the folder's name and
    not the key."""
    return spark.read.text(path).select(F.unbase64("value")).scalar()


def _as_column(key: bytes | Column) -> Column:
    # bytes stand in the plan for all to see: for tests and passing values
    return key if isinstance(key, Column) else F.lit(key)


def encrypt(col: Column, key: bytes | Column) -> Column:
    """Base64 text; Spark draws a new IV per value and stores it in front. ``key`` is best a :func:`stored_key`."""
    return F.base64(F.aes_encrypt(col, _as_column(key), F.lit("CBC"), F.lit("PKCS")))


def decrypt(col: Column, key: bytes | Column) -> Column:
    return F.aes_decrypt(F.unbase64(col), _as_column(key), F.lit("CBC"), F.lit("PKCS")).cast("string")


def encrypt_columns(df: DataFrame, columns: list[str], key: bytes | Column) -> DataFrame:
    return df.withColumns({c: encrypt(F.col(c).cast("string"), key) for c in columns})


def decrypt_columns(df: DataFrame, columns: list[str], key: bytes | Column) -> DataFrame:
    return df.withColumns({c: decrypt(F.col(c), key) for c in columns})
