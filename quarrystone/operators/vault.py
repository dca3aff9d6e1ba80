"""The vault's keys: derivation, wrapping, and the vault's state in the store's ``sys`` table.

A folder key encrypts payloads; a key derived from a password and a key file wraps it.  scrypt (memory-hard, in
Python's library) and AES-GCM (in Spark) stand for the reference's derivation and cipher.
"""

from __future__ import annotations

import errno
import hashlib
import secrets
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FLAG_VAULT, FLAG_VAULT_ROOT, KIND_DIR, ROOT_INO
from . import dml

VAULT_NAME = ".vault"
#: scrypt's cost: 128 * 8 * N bytes of memory.
COST = 1 << 14


def generate_key() -> bytes:
    return secrets.token_bytes(32)


def derive_key(password: str, key_file: bytes, salt: bytes) -> bytes:
    """Both the password and the key file's material are needed."""
    return hashlib.scrypt(password.encode() + b"\0" + key_file, salt=salt, n=COST, r=8, p=1, maxmem=1 << 28, dklen=32)


@dataclass(frozen=True)
class Wrapped:
    salt: bytes
    sealed: bytes


def wrap(spark: SparkSession, folder_key: bytes, password: str, key_file: bytes) -> Wrapped:
    salt = secrets.token_bytes(16)
    sealed = spark.range(1).select(F.aes_encrypt(F.lit(folder_key), F.lit(derive_key(password, key_file, salt)), F.lit("GCM"))).first()[0]
    return Wrapped(salt, bytes(sealed))


def unwrap(spark: SparkSession, record: Wrapped, password: str, key_file: bytes) -> bytes:
    """The folder key; another password or key file, or a tampered record, is refused."""
    key = derive_key(password, key_file, record.salt)
    out = spark.range(1).select(F.try_aes_decrypt(F.lit(record.sealed), F.lit(key), F.lit("GCM"))).first()[0]
    if out is None:
        raise PermissionError(errno.EACCES, "wrong password or key file")
    return bytes(out)


def encrypt(payload: Column | str, folder_key: bytes) -> Column:
    return F.aes_encrypt(payload, F.lit(folder_key), F.lit("GCM"))


def decrypt(payload: Column | str, folder_key: bytes) -> Column:
    """Null where the payload was tampered with."""
    return F.try_aes_decrypt(payload, F.lit(folder_key), F.lit("GCM"))


@dataclass(frozen=True)
class Vault:
    """What a session knows: the wrapped key of the store, and the folder key while the vault is unlocked."""

    record: Wrapped
    folder_key: bytes | None = None

    def unlock(self, spark: SparkSession, password: str, key_file: bytes) -> Vault:
        folder_key = unwrap(spark, self.record, password, key_file)
        if self.folder_key is not None:
            raise OSError(errno.EALREADY, "the vault is unlocked")
        return replace(self, folder_key=folder_key)

    def lock(self) -> Vault:
        if self.folder_key is None:
            raise OSError(errno.EALREADY, "the vault is locked")
        return replace(self, folder_key=None)

    def key(self) -> bytes:
        if self.folder_key is None:
            raise PermissionError(errno.EACCES, "the vault is locked")
        return self.folder_key


def create(t: dml.Tables, ino: int, password: str, now: int) -> tuple[dml.Tables, Vault, bytes]:
    """The namespace with the vault's folder, the locked vault, and the material for its key file.  A second vault is refused."""
    spark = t.dirents.sparkSession
    material = generate_key()
    folder = spark.createDataFrame([(ROOT_INO, VAULT_NAME, ino, KIND_DIR, 0o700, 0, 0)], "parent long, name string, ino long, kind int, perm int, uid long, gid long")
    out = dml.create(t, folder, now)
    flags = F.when(F.col("ino") == ino, FLAG_VAULT | FLAG_VAULT_ROOT).otherwise(F.col("flags"))
    inodes: DataFrame = out.inodes.withColumn("flags", flags)
    return replace(out, inodes=inodes), Vault(wrap(spark, generate_key(), password, material)), material
