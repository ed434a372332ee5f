"""Predicates over references, object ids, file modes, scores and wire values (F1-F14, F20). Null gives null, unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MODES = ("000000", "100644", "100755", "120000", "160000")
OBJECT_TYPES = ("blob", "tree", "commit", "tag")
MAX_REF_SCALARS = 4096
MAX_INT = 2_147_483_647
FORBIDDEN_IN_REF = r"[ ~^:?*\[\\]"


def is_object_id(c: Column) -> Column:
    """40 or 64 lower-case hex digits."""
    return c.rlike(r"\A([0-9a-f]{40}|[0-9a-f]{64})\z")


def is_zero_oid(c: Column) -> Column:
    """Only zeros, and at least one."""
    return c.rlike(r"\A0+\z")


def same_width(*ids: Column) -> Column:
    """Object ids of one length."""
    out = is_object_id(ids[0])
    for a, b in zip(ids, ids[1:], strict=False):
        out = out & is_object_id(b) & (F.length(a) == F.length(b))
    return out


def is_mode(c: Column) -> Column:
    """A supported file mode."""
    return c.isin(*MODES)


def is_present_mode(c: Column) -> Column:
    """A supported file mode of something that exists."""
    return c.isin(*MODES[1:])


def is_absent_mode(c: Column) -> Column:
    """The mode of nothing."""
    return c == MODES[0]


def is_gitlink(c: Column) -> Column:
    """The mode of a submodule."""
    return c == "160000"


def file_type(c: Column) -> Column:
    """f, l or g for a file, link or submodule; empty otherwise."""
    return F.when(c.isin("100644", "100755"), "f").when(c == "120000", "l").when(c == "160000", "g").otherwise("")


class Side(NamedTuple):
    """One side of a change: whether something is there, and whether mode and id agree on that."""

    there: Column
    sound: Column


def side(mode: Column, oid: Column) -> Side:
    """A side by its mode and object id: nothing has the mode and the id of nothing, a file has neither."""
    return Side(~is_zero_oid(oid), is_mode(mode) & (is_absent_mode(mode) == is_zero_oid(oid)))


#: git's change letters, from its documentation. For each letter: is there an old side, is there a new one,
#: are both of one type, are both the same; None where the letter says nothing of it.
DIFF_LETTERS = {
    "A": (False, True, None, None),
    "D": (True, False, None, None),
    "M": (True, True, True, False),
    "T": (True, True, False, None),
    "R": (True, True, True, None),
}
INDEX_LETTERS = {
    ".": (True, True, None, True),
    "A": (False, True, None, None),
    "D": (True, False, None, None),
    "M": (True, True, True, False),
    "T": (True, True, False, None),
}
WORKTREE_LETTERS = {
    ".": (None, None, None, True),
    "D": (True, False, None, None),
    "M": (True, True, True, None),
    "T": (True, True, False, None),
}
#: git's conflict letters, and which of the stages 1 (base), 2 (ours) and 3 (theirs) exist.
CONFLICT_LETTERS = {
    "DD": (True, False, False),
    "AU": (False, True, False),
    "UD": (True, True, False),
    "UA": (False, False, True),
    "DU": (True, False, True),
    "AA": (False, True, True),
    "UU": (True, True, True),
}


def obeys(letter: Column, rules: dict[str, tuple[bool | None, ...]], *facts: Column) -> Column:
    """Whether the facts are those that a letter's rule asks for; false for a letter without a rule."""
    asked = [F.create_map(*(F.lit(x) for k, rule in rules.items() for x in (k, rule[n])))[letter] for n in range(len(facts))]
    met = [F.coalesce(want == fact, F.lit(True)) for want, fact in zip(asked, facts, strict=True)]
    return reduce(and_, met, letter.isin(*rules))


def transition_ok(status: Column, source_mode: Column, target_mode: Column, source_oid: Column, target_oid: Column) -> Column:
    """Whether modes and ids fit a change letter A, D, M, T or R."""
    old, new = side(source_mode, source_oid), side(target_mode, target_oid)
    same = (source_mode == target_mode) & (source_oid == target_oid)
    return old.sound & new.sound & obeys(status, DIFF_LETTERS, old.there, new.there, file_type(source_mode) == file_type(target_mode), same)


def rename_score_ok(c: Column, padded: bool) -> Column:
    """R and a number of 50 to 100: three digits if padded, without leading zero if not."""
    shape = c.rlike(r"\AR[0-9]{3}\z") if padded else c.rlike(r"\AR[1-9][0-9]{1,2}\z")
    return shape & F.substring(c, 2, 3).try_cast("int").between(50, 100)


def index_state_ok(status: Column, head_mode: Column, index_mode: Column, head_oid: Column, index_oid: Column) -> Column:
    """Whether the index letter of a status entry fits its modes and ids."""
    head, index = side(head_mode, head_oid), side(index_mode, index_oid)
    same = (head_mode == index_mode) & (head_oid == index_oid)
    return head.sound & index.sound & obeys(status, INDEX_LETTERS, head.there, index.there, file_type(head_mode) == file_type(index_mode), same)


def worktree_mode_ok(status: Column, index_mode: Column, worktree_mode: Column) -> Column:
    """Whether the working-tree letter of a status entry fits its modes."""
    there = [~is_absent_mode(m) for m in (index_mode, worktree_mode)]
    return obeys(status, WORKTREE_LETTERS, *there, file_type(index_mode) == file_type(worktree_mode), index_mode == worktree_mode)


def unmerged_ok(status: Column, one: Column, two: Column, three: Column) -> Column:
    """Whether a conflict's letters fit the stages that exist."""
    return obeys(status, CONFLICT_LETTERS, one, two, three)


def no_control(c: Column) -> Column:
    """No control character."""
    return ~c.rlike(r"[\x{0}-\x{1F}\x{7F}-\x{9F}]")


def is_full_ref(c: Column) -> Column:
    """A full reference name."""
    parts_ok = F.forall(F.split(c, "/", -1), lambda p: (F.length(p) > 0) & ~p.startswith(".") & ~p.endswith(".lock"))
    bad = c.contains("..") | c.contains("//") | c.contains("@{") | c.rlike(FORBIDDEN_IN_REF) | c.rlike(r"[/.]\z")
    return c.startswith("refs/") & (F.length(c) > 5) & ~bad & no_control(c) & parts_ok


def is_target_ref(c: Column) -> Column:
    """A reference that can be compared with: a branch, or a remote's branch, of at most 4096 characters."""
    return is_full_ref(c) & (F.length(c) <= MAX_REF_SCALARS) & (c.rlike(r"\Arefs/heads/.") | c.rlike(r"\Arefs/remotes/[^/]+/."))


def is_token(c: Column) -> Column:
    """A fingerprint: 64 lower-case hex digits."""
    return c.rlike(r"\A[0-9a-f]{64}\z")


def is_uuid(c: Column) -> Column:
    """A UUID in lower-case text."""
    return c.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")


def is_uuid_v4(c: Column) -> Column:
    """A random UUID in lower-case text."""
    return c.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")


def non_blank(c: Column) -> Column:
    """Some character that isn't white space; false for null."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))


def is_count(c: Column) -> Column:
    """A number that a non-negative 32-bit integer holds."""
    return c.between(0, MAX_INT)


def checked_count(c: Column) -> Column:
    """A count as a 32-bit integer; an error with the class tooLarge where it doesn't fit."""
    return F.when(c > MAX_INT, F.raise_error(F.lit("tooLarge"))).otherwise(c.cast("int"))


def bounded_utf8(c: Column, most: int) -> Column:
    """Bytes that are UTF-8, at most ``most`` of them."""
    return F.is_valid_utf8(c) & (F.octet_length(c) <= most)


def path_key(c: Column, fold_case: bool) -> Column:
    """The key that paths are equal by."""
    return F.upper(c) if fold_case else c


def relative_path(path: Column, root: Column, name: Column, outside: str = "<outside>") -> Column:
    """``name/rest`` for a path in ``root``, ``name`` for root itself, a placeholder elsewhere."""
    base = F.regexp_replace(root, r"/+\z", "")
    inside = path.startswith(F.concat(base, F.lit("/")))
    return F.when(path == base, name).when(inside, F.concat(name, F.substring(path, F.length(base) + 1, F.length(path)))).otherwise(outside)


def redact_home(path: Column, home: Column) -> Column:
    """A path with the home directory as ``~``."""
    return F.when(path == home, "~").when(path.startswith(F.concat(home, F.lit("/"))), F.concat(F.lit("~"), F.substring(path, F.length(home) + 1, F.length(path)))).otherwise(path)


def head_variant(exit_code: Column, branch: Column, revision: Column) -> Column:
    """kind, name and revision of a head: a branch where its name could be read, detached where not."""
    named = (exit_code == 0) & non_blank(branch)
    return F.struct(F.when(named, "branch").otherwise("detached").alias("kind"), F.when(named, branch).alias("name"), revision.alias("revision"))
