"""SSH and GPG signatures of commits and tags, checked by ``ssh-keygen`` and ``gpg`` in Arrow batches.

The signature's own structure (hash, namespace, flags of security keys) is read here; the tools only
do the cryptography.
"""

from __future__ import annotations

import base64
import os
import subprocess
import tempfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "-----BEGIN SSH SIGNATURE-----", "-----END SSH SIGNATURE-----"
SECURITY_KEYS = ("sk-ssh-ed25519@openssh.com", "sk-ecdsa-sha2-nistp256@openssh.com")
#: Bits of a security key's flags.
PRESENT, VERIFIED = 1, 4


@dataclass(frozen=True)
class SshSignature:
    public_key: bytes
    key_type: str
    namespace: str
    hash: str
    flags: int | None

    @classmethod
    def parse(cls, armored: str) -> SshSignature:
        lines = armored.strip().splitlines()
        if not lines or lines[0] != BEGIN or lines[-1] != END:
            raise ValueError("no SSH signature")
        raw = base64.b64decode("".join(lines[1:-1]), validate=True)
        if raw[:6] != b"SSHSIG" or raw[6:10] != b"\0\0\0\1":
            raise ValueError("not version 1 of SSHSIG")
        fields, at = [], 10
        for _ in range(5):  # key, namespace, reserved, hash, signature
            value, at = _string(raw, at)
            fields.append(value)
        kind, _ = _string(fields[0], 0)
        own, end = _string(fields[4], 0)
        _, end = _string(fields[4], end)
        flags = fields[4][end] if own.decode() in SECURITY_KEYS else None
        return cls(fields[0], kind.decode(), fields[1].decode(), fields[3].decode(), flags)


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    n = int.from_bytes(raw[at : at + 4], "big")
    if at + 4 + n > len(raw):
        raise ValueError("cut short")
    return raw[at + 4 : at + 4 + n], at + 4 + n


def ssh_problem(content: bytes, signature: str, keys: list[str], namespace: str = "git", allow_sha256: bool = False, present: bool = False, verified: bool = False) -> str | None:
    """Why an SSH signature of ``content`` by one of ``keys`` (public-key lines) does not hold; null if it does."""
    try:
        found = SshSignature.parse(signature)
    except ValueError as error:
        return f"malformed: {error}"
    own = base64.b64encode(found.public_key).decode()
    if own not in [k.split()[1] for k in keys if len(k.split()) > 1]:
        return "key is not the signer's"
    if found.namespace != namespace:
        return f"namespace {found.namespace}"
    if found.hash != "sha512" and not (found.hash == "sha256" and allow_sha256):
        return f"hash {found.hash} is not allowed"
    if (present or verified) and found.flags is None:
        return f"key type {found.key_type} has no user presence"
    if present and not found.flags & PRESENT:
        return "user was not present"
    if verified and not found.flags & VERIFIED:
        return "user was not verified"
    with tempfile.TemporaryDirectory() as folder:
        for name, text in (("signature", signature.encode()), ("signers", f"signer {found.key_type} {own}\n".encode())):
            with open(os.path.join(folder, name), "wb") as f:
                f.write(text)
        run = subprocess.run(["ssh-keygen", "-Y", "verify", "-f", f"{folder}/signers", "-I", "signer", "-n", namespace, "-s", f"{folder}/signature"], input=content, capture_output=True)
    return None if run.returncode == 0 else "signature does not match"


def gpg_problem(content: bytes, signature: str, keys: list[str], email: str | None = None) -> str | None:
    """Why a GPG signature by one of ``keys`` (armoured, one public key each) does not hold; null if it does.

    With ``email``, the key must carry that address.
    """
    with tempfile.TemporaryDirectory() as folder:
        gpg = ["gpg", "--homedir", folder, "--batch", "--no-tty", "--quiet"]
        for key in keys:
            run = subprocess.run([*gpg, "--import"], input=key.encode(), capture_output=True)
            if run.returncode:
                return "malformed key"
        listed = subprocess.run([*gpg, "--with-colons", "--list-keys"], capture_output=True, text=True).stdout.splitlines()
        if sum(x.startswith("pub:") for x in listed) != len(keys):
            return "expected one key in each entry"
        if email and not any(x.startswith("uid:") and f"<{email}>" in x for x in listed):
            return "key has another address"
        with open(f"{folder}/signature", "w") as f:
            f.write(signature)
        run = subprocess.run([*gpg, "--verify", f"{folder}/signature", "-"], input=content, capture_output=True)
    return None if run.returncode == 0 else "signature does not match"


def signature_problem(content: Column, signature: Column, keys: Column, namespace: str = "git", **rules: bool) -> Column:
    """``ssh_problem`` over columns: content (bytes), signature and keys (array of lines)."""

    @F.pandas_udf("string")
    def check(c: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([ssh_problem(bytes(a), b, list(x) if x is not None else [], namespace, **rules) for a, b, x in zip(c, s, k, strict=True)], dtype=object)

    return check(content.cast("binary"), signature, keys)


def gpg_signature_problem(content: Column, signature: Column, keys: Column, email: Column) -> Column:
    """``gpg_problem`` over columns: content (bytes), signature, keys (array of armoured keys) and the signer's address."""

    @F.pandas_udf("string")
    def check(c: pd.Series, s: pd.Series, k: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([gpg_problem(bytes(a), b, list(x) if x is not None else [], y) for a, b, x, y in zip(c, s, k, e, strict=True)], dtype=object)

    return check(content.cast("binary"), signature, keys, email)


def verified(signed: DataFrame, keys: DataFrame, rules: dict, forge_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """``repo_id, hash, valid, problem`` of commits or tags (repo_id, hash, raw, signature, email of the signer).

    keys: email, ssh_keys, gpg_keys of identities; the signer's own keys count only. rules: as of
    ``policy.RULES``; SSH signatures must show what these ask for. forge_keys: GPG keys of forges by the
    address they commit with. Rows without a signature are left out; of signers without keys none is valid.
    """
    forge = [F.when(F.col("email") == e, F.array(*map(F.lit, k))) for e, k in (forge_keys or {}).items()]
    rows = signed.where("signature is not null and signature != ''").select("repo_id", "hash", "raw", "signature", "email")
    rows = rows.join(keys.select("email", "ssh_keys", "gpg_keys").dropDuplicates(["email"]), "email", "left").withColumn("gpg_keys", F.coalesce(*forge, "gpg_keys"))
    content = F.when(F.decode("raw", "ISO-8859-1").startswith("tree "), signed_commit(F.col("raw"))).otherwise(signed_tag(F.col("raw")))
    rows = rows.withColumn("content", content)
    kind = F.col("signature")
    options = {"allow_sha256": bool(rules.get("allow_ssh_sha256")), "present": bool(rules.get("require_ssh_user_present")), "verified": bool(rules.get("require_ssh_user_verified"))}
    ssh, gpg = rows.where(kind.startswith(BEGIN)), rows.where(kind.startswith("-----BEGIN PGP SIGNATURE-----"))
    other = rows.where(~kind.startswith(BEGIN) & ~kind.startswith("-----BEGIN PGP SIGNATURE-----"))
    found = ssh.withColumn("problem", signature_problem(F.col("content"), kind, F.col("ssh_keys"), **options))
    found = found.unionByName(gpg.withColumn("problem", gpg_signature_problem(F.col("content"), kind, F.col("gpg_keys"), F.col("email"))))
    found = found.unionByName(other.withColumn("problem", F.lit("unknown signature")))
    return found.select("repo_id", "hash", F.col("problem").isNull().alias("valid"), "problem")


def _plain(raw: Column) -> Column:
    """Bytes as text of a character each, so that what is not UTF-8 stays as it is."""
    return F.decode(raw, "ISO-8859-1")


def _encoded(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def signed_commit(raw: Column) -> Column:
    """The bytes of a commit that its signature covers: all but the gpgsig header."""
    return _encoded(F.regexp_replace(_plain(raw), r"(?s)\A((?:(?!\n\n).)*?\n)gpgsig(?:-sha256)? [^\n]*\n(?: [^\n]*\n)*", "$1"))


def signed_tag(raw: Column) -> Column:
    """The bytes of a tag that its signature covers: all before the armour."""
    return _encoded(F.regexp_replace(_plain(raw), r"(?s)-----BEGIN (?:SSH|PGP) SIGNATURE-----.*\z", ""))


# --- merges -----------------------------------------------------------------------------------------


def merge_state(path: str, commit: str, tree: str, parents: list[str]) -> tuple[bool, bool]:
    """Of a merge: whether merging its parents again gives its tree, and whether their base is the first one."""
    git = ["git", "-c", "safe.directory=*", "-C", path]
    made = subprocess.run([*git, "merge-tree", "--write-tree", *parents], capture_output=True, text=True)
    base = subprocess.run([*git, "merge-base", *parents], capture_output=True, text=True)
    return made.returncode == 0 and made.stdout.strip() == tree, base.stdout.strip() == parents[0]


def merge_states(commits, path_of: dict[str, str]):
    """``repo_id, hash, clean, up_to_date`` of the merges in ``commits``, by ``git`` on executors that see the repositories."""

    def run(batches):
        for rows in batches:
            found = [merge_state(path_of[r], h, t, list(p)) for r, h, t, p in zip(rows["repo_id"], rows["hash"], rows["tree_hash"], rows["parents"], strict=True)]
            yield pd.DataFrame({"repo_id": rows["repo_id"], "hash": rows["hash"], "clean": [x[0] for x in found], "up_to_date": [x[1] for x in found]})

    merges = commits.where(F.size("parents") == 2).select("repo_id", "hash", "tree_hash", "parents")
    return merges.mapInPandas(run, "repo_id string, hash string, clean boolean, up_to_date boolean")
