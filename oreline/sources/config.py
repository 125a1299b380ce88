"""Policy configurations: strict JSON in, one relation per section out."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

VERSION = "v0.1"
_HASH = {"sha1": str, "sha512": str}
_FORGE = {"allowmergecommits": bool, "allowcontentcommits": bool}
_RULES = {
    "allowsshsignatures": "allow_ssh_signatures", "requiresshuserpresent": "require_ssh_user_present", "requiresshuserverified": "require_ssh_user_verified", "allowsshsha256": "allow_ssh_sha256",
    "allowgpgsignatures": "allow_gpg_signatures", "requiresignedtags": "require_signed_tags", "requiremergecommits": "require_merge_commits", "requireuptodate": "require_up_to_date",
}
_IDENTITY = {"email": str, "additionalemails": [str], "gpgpublickeys": [str], "sshpublickeys": [str], "forgeusername": str, "forgeuserid": str}
_SHARED = {"identities": [_IDENTITY], "maintainers": [str], "contributors": [str], "rules": dict.fromkeys(_RULES, bool), "protectedbranches": [str], "forgerules": _FORGE}
_REPOSITORY = _SHARED | {"uri": str, "after": [_HASH | {"branch": str}], "exempttags": [{"ref": str, "hash": _HASH}]}
_CONFIG = _SHARED | {"_type": str, "forgeid": str, "repositories": [_REPOSITORY]}


def _checked(value, shape, at: str):
    """``value`` with keys lowered; an error where it has an unknown field or another type than ``shape``."""
    if value is None:
        return None
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: expected an object")
        low = {k.lower(): v for k, v in value.items()}
        if unknown := set(low) - set(shape):
            raise ValueError(f"{at}: unknown field {sorted(unknown)[0]}")
        return {k: _checked(v, shape[k], f"{at}.{k}") for k, v in low.items()}
    if isinstance(shape, list):
        if not isinstance(value, list):
            raise ValueError(f"{at}: expected a list")
        return [_checked(v, shape[0], at) for v in value]
    if not isinstance(value, shape):
        raise ValueError(f"{at}: expected {shape.__name__}")
    return value


def load(text: str) -> list[dict]:
    """A policy per repository: uri, identities, maintainers, contributors, rules, protectedbranches, forgerules, after,
    exempttags and forgeid. A repository's section replaces the global one; keys may have any case."""
    config = _checked(json.loads(text), _CONFIG, "config")
    if not str(config.get("_type", "")).endswith(VERSION):
        raise ValueError(f"expected version {VERSION} of the schema")
    out = []
    for repo in config.get("repositories") or []:
        if not re.fullmatch(r"git\+(https|ssh)://[^?#]*\.git", repo.get("uri") or ""):
            raise ValueError(f"invalid repository uri {repo.get('uri')}")
        policy = {k: repo[k] if repo.get(k) is not None else config.get(k) for k in _SHARED}
        policy |= {"uri": repo["uri"], "after": repo.get("after") or [], "exempttags": repo.get("exempttags") or [], "forgeid": config.get("forgeid")}
        policy["rules"] = {_RULES[k]: v for k, v in (policy["rules"] or {}).items() if v is not None}
        known = {i["email"] for i in policy["identities"] or []}
        for role in ("maintainers", "contributors"):
            if missing := [e for e in policy[role] or [] if e not in known]:
                raise ValueError(f"{role} without identity: {missing[0]}")
        for after in policy["after"]:
            for kind, n in (("sha1", 40), ("sha512", 128)):
                if after.get(kind) is not None and not re.fullmatch(f"[a-f0-9]{{{n}}}", after[kind]):
                    raise ValueError(f"invalid {kind} {after[kind]}")
        for key in ("branch", "sha1", "sha512"):
            named = [a[key] for a in policy["after"] if a.get(key)]
            if len(named) != len(set(named)):
                raise ValueError(f"repeated {key} in after")
        out.append(policy)
    return out


def read(path: str) -> list[dict]:
    """``load`` of a file; paths that start with ``~`` are rejected."""
    if path.startswith("~"):
        raise ValueError("paths must not start with ~")
    with open(os.path.abspath(path)) as f:
        return load(f.read())


def identities(spark: SparkSession, policy: dict) -> tuple[DataFrame, DataFrame]:
    """Identities and roles of a policy, as ``policy.emails`` takes them."""
    rows = [(i.get("email"), i.get("additionalemails") or [], i.get("gpgpublickeys") or [], i.get("sshpublickeys") or [], i.get("forgeusername"), i.get("forgeuserid")) for i in policy["identities"] or []]
    roles = [(e, True) for e in policy["maintainers"] or []] + [(e, False) for e in policy["contributors"] or []]
    shape = "email string, additional_emails array<string>, gpg_keys array<string>, ssh_keys array<string>, forge_username string, forge_user_id string"
    return spark.createDataFrame(rows, shape), spark.createDataFrame(roles, "email string, maintainer boolean")
