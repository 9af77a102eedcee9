"""ACL: users as folds of rules, and access checked for whole tables of commands."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patterns import glob_regex
from .positions import categories, key_args
from .registry import COMMANDS

_BY_CATEGORY: dict[str, frozenset[str]] = {}
for _c in COMMANDS.values():
    for _name in categories(_c):
        _BY_CATEGORY[_name] = _BY_CATEGORY.get(_name, frozenset()) | {_c.name.lower()}
_ALL = frozenset(n.lower() for n in COMMANDS)


def cat(category: str | None = None) -> list[str]:
    """ACL CAT: all categories, or the commands of one."""
    if category is None:
        return sorted(_BY_CATEGORY)
    if category.lower() not in _BY_CATEGORY:
        raise ValueError(f"Unknown ACL cat '{category}'")
    return sorted(_BY_CATEGORY[category.lower()])


def genpass(bits: int = 256) -> str:
    """ACL GENPASS: a random hexadecimal password of so many bits, rounded up to whole digits."""
    if not 0 < bits <= 4096:
        raise ValueError("the number of bits must be a positive number up to 4096")
    digits = -(-bits // 4)
    return secrets.token_hex(-(-digits // 2))[:digits]


def _digest(password: str) -> str:
    return hashlib.sha256(password.encode()).hexdigest()


def _with(items: tuple[str, ...], item: str) -> tuple[str, ...]:
    return items if item in items else (*items, item)


@dataclass(frozen=True)
class User:
    """A user who may do nothing until rules say otherwise; passwords are SHA-256 digests."""

    name: str
    enabled: bool = False
    nopass: bool = False
    passwords: tuple[str, ...] = ()
    commands: frozenset[str] = frozenset()
    rules: tuple[str, ...] = ()
    all_keys: bool = False
    keys: tuple[str, ...] = ()
    all_channels: bool = False
    channels: tuple[str, ...] = ()

    def apply(self, rule: str) -> User:
        """The user after one rule; an unknown rule is an error."""
        word = rule.lower()
        if word in _WORDS:
            return replace(self, **_WORDS[word])
        mark, rest = rule[:1], rule[1:]
        if mark in ("#", "!") and not re.fullmatch("[0-9a-f]{64}", rest.lower()):
            raise ValueError(f"Error in ACL SETUSER modifier '{rule}': a password hash has 64 hexadecimal digits")
        if mark in (">", "#"):
            return replace(self, passwords=_with(self.passwords, _digest(rest) if mark == ">" else rest.lower()), nopass=False)
        if mark in ("<", "!"):
            gone = _digest(rest) if mark == "<" else rest.lower()
            return replace(self, passwords=tuple(p for p in self.passwords if p != gone))
        if mark == "~":
            return replace(self, keys=_with(self.keys, rest))
        if mark == "&":
            return replace(self, channels=_with(self.channels, rest))
        if mark not in ("+", "-") or not rest:
            raise ValueError(f"Error in ACL SETUSER modifier '{rule}': Syntax error")
        named = _BY_CATEGORY.get(word[2:]) if word[1] == "@" else frozenset({word[1:]}) & _ALL
        if not named:
            raise ValueError(f"Error in ACL SETUSER modifier '{word}': Unknown command or category name in ACL")
        return replace(self, commands=self.commands | named if mark == "+" else self.commands - named, rules=(*self.rules, word))

    def accepts(self, password: str) -> bool:
        """AUTH."""
        if not self.enabled or self.nopass:
            return self.enabled
        return any([hmac.compare_digest(p, _digest(password)) for p in self.passwords])

    def describe(self) -> dict[str, object]:
        """ACL GETUSER."""
        flags = ["on" if self.enabled else "off"] + [f for f, is_set in (("nopass", self.nopass), ("allkeys", self.all_keys), ("allchannels", self.all_channels)) if is_set]
        return {
            "flags": flags,
            "passwords": list(self.passwords),
            "commands": " ".join(self.rules) or "-@all",
            "keys": "~*" if self.all_keys else " ".join("~" + p for p in self.keys),
            "channels": "&*" if self.all_channels else " ".join("&" + p for p in self.channels),
        }

    def line(self) -> str:
        """A row of ACL LIST; its rules give the same user again."""
        words = ["on" if self.enabled else "off", *(["nopass"] if self.nopass else []), *("#" + p for p in self.passwords)]
        words += [*(["~*"] if self.all_keys else []), *("~" + p for p in self.keys), *(["&*"] if self.all_channels else []), *("&" + p for p in self.channels)]
        return " ".join(["user", self.name, *words, *(self.rules or ("-@all",))])


_EVERY_KEY, _NO_KEY = {"all_keys": True, "keys": ()}, {"all_keys": False, "keys": ()}
_EVERY_CHANNEL, _NO_CHANNEL = {"all_channels": True, "channels": ()}, {"all_channels": False, "channels": ()}
_EVERY_COMMAND, _NO_COMMAND = {"commands": _ALL, "rules": ("+@all",)}, {"commands": frozenset(), "rules": ("-@all",)}
#: Rules that are a word, and what each sets.
_WORDS = {
    "on": {"enabled": True},
    "off": {"enabled": False},
    "nopass": {"nopass": True, "passwords": ()},
    "resetpass": {"nopass": False, "passwords": ()},
    "reset": {"enabled": False, "nopass": False, "passwords": (), "commands": frozenset(), "rules": ()} | _NO_KEY | _NO_CHANNEL,
    "allkeys": _EVERY_KEY,
    "~*": _EVERY_KEY,
    "resetkeys": _NO_KEY,
    "allchannels": _EVERY_CHANNEL,
    "&*": _EVERY_CHANNEL,
    "resetchannels": _NO_CHANNEL,
    "allcommands": _EVERY_COMMAND,
    "+@all": _EVERY_COMMAND,
    "nocommands": _NO_COMMAND,
    "-@all": _NO_COMMAND,
}
Users = dict[str, User]


def set_user(users: Users, name: str, rules: list[str]) -> Users:
    """ACL SETUSER: rules in their order, all or none."""
    if re.search(r"[\s\0]", name):
        raise ValueError("Usernames can't contain spaces or null characters")
    user = users.get(name, User(name))
    for rule in rules:
        user = user.apply(rule)
    return users | {name: user}


def del_user(users: Users, names: list[str]) -> tuple[Users, int]:
    """ACL DELUSER: who is left, and how many went; the default user stays."""
    if "default" in names:
        raise ValueError("the 'default' user cannot be removed")
    gone = set(names) & set(users)
    return {n: u for n, u in users.items() if n not in gone}, len(gone)


def open_users(requirepass: str = "") -> Users:
    """The users of a new keyspace: a default one who may do everything, with a password if one is named."""
    return set_user({}, "default", ["on", f">{requirepass}" if requirepass else "nopass", "~*", "&*", "+@all"])


def frame(spark: SparkSession, users: Users) -> DataFrame:
    """ACL LIST and ACL USERS: a row a user, with the patterns as regular expressions."""

    def regex(every: bool, patterns: tuple[str, ...]) -> str:
        return "" if every else "|".join(f"(?:{glob_regex(p)})" for p in patterns) or "(?!)"

    rows = [(u.name, u.enabled, sorted(u.commands), regex(u.all_keys, u.keys), regex(u.all_channels, u.channels), u.line()) for u in users.values()]
    return spark.createDataFrame(rows, "user string, enabled boolean, commands array<string>, key_regex string, channel_regex string, line string")


def decide(commands: DataFrame, users: Users) -> DataFrame:
    """Whether each command of a log may run: ``denied`` is null, or user, command, key or channel.

    ``commands``: ``user, verb, args`` and further columns.  What is broadcast
    is the configuration, one row a user, not data.
    """
    rules = frame(commands.sparkSession, users).select(F.col("user").alias("_user"), "enabled", "commands", "key_regex", "channel_regex")
    both = commands.join(F.broadcast(rules), F.col("user") == F.col("_user"), "left")
    verb, args = F.lower("verb"), F.transform("args", lambda a: a.cast("string"))
    named = F.when(verb.isin("subscribe", "psubscribe"), args).when(verb == "publish", F.slice(args, 1, 1)).otherwise(F.slice(args, 1, 0))
    # A pattern subscription must name one of the user's own patterns or be allowed as a text.
    foreign = lambda xs, regex: F.exists(xs, lambda x: ~F.rlike(x, F.col(regex)))
    denied = (
        F.when(F.col("_user").isNull() | ~F.col("enabled"), "user")
        .when(~F.array_contains("commands", verb), "command")
        .when(foreign(key_args(F.col("verb"), args), "key_regex"), "key")
        .when(foreign(named, "channel_regex"), "channel")
    )
    return both.withColumn("denied", denied).select(*(F.col(f"`{c}`") for c in commands.columns if c != "denied"), "denied")
