"""UUIDs, hashes and encodings."""

from __future__ import annotations

from .strings import text, unquote

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__.rstrip("_")] = f
    return f


_UUID = "'^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$'"

for _name in ("uuid_v4", "newid", "gen_random_uuid", "uuid", "newsequentialid"):
    FUNCTIONS[_name] = lambda: "uuid()"


@rule
def uuid_v7():
    """48 bits of milliseconds, the version, and random bits."""
    ms, r = "lpad(lower(hex(unix_millis(now()))), 12, '0')", "uuid()"
    return f"concat(left({ms}, 8), '-', right({ms}, 4), '-7', substring({r}, 16, 3), '-', substring({r}, 20))"


@rule
def uuid_nil():
    return "'00000000-0000-0000-0000-000000000000'"


@rule
def uuid_is_valid(u):
    return f"cast(coalesce({text(u)} rlike {_UUID}, false) as int)"


@rule
def uuid_version(u):
    return f"(case when {text(u)} rlike {_UUID} then cast(conv(substring({text(u)}, 15, 1), 16, 10) as int) end)"


@rule
def uuid_to_blob(u):
    return f"(case when {text(u)} rlike {_UUID} then unhex(replace({text(u)}, '-', '')) end)"


@rule
def uuid_from_blob(b):
    return f"(case when octet_length({b}) = 16 then regexp_replace(lower(hex({b})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5') end)"


@rule
def sha256(x):
    return f"sha2(cast({x} as binary), 256)"


@rule
def sha512(x):
    return f"sha2(cast({x} as binary), 512)"


@rule
def md5(x):
    return f"md5(cast({x} as binary))"


@rule
def sha1(x):
    return f"sha1(cast({x} as binary))"


@rule
def hashbytes(algorithm, x):
    rules = {"MD5": md5, "SHA1": sha1, "SHA": sha1, "SHA2_256": sha256, "SHA2_512": sha512}
    name = (unquote(algorithm) or "").upper()
    if name not in rules:
        raise ValueError(f"unsupported hash {name}")
    return f"unhex({rules[name](x)})"


@rule
def hmac_sha256(key, message):
    return f"ls_hmac_sha256({text(key)}, {text(message)})"


@rule
def base64_encode(x):
    return f"regexp_replace(base64(cast({x} as binary)), '\\\\s', '')"


@rule
def base64_decode(x):
    return f"cast(unbase64({x}) as string)"  # the bytes are kept, whatever they are


@rule
def hex_encode(x):
    return f"lower(hex(cast({x} as binary)))"


@rule
def hex_decode(x):
    return f"(case when {x} is null then null when char_length({x}) % 2 = 0 and {x} rlike '^[0-9A-Fa-f]*$' then cast(unhex({x}) as string) else raise_error('HEX_DECODE needs an even number of hex digits') end)"


@rule
def random_string(n):
    return f"substring(repeat(replace(uuid(), '-', ''), cast(ceil({n} / 32.0) as int)), 1, {n})"


@rule
def unhex(x):
    return f"unhex({x})"


@rule
def hex_(x):
    return f"hex({x})"
