"""Chat formatting at token level.

Every turn becomes segments: reserved ids, which no text can produce, and texts that are encoded
one by one. The loss mask is the prefix sum of +1 where an assistant text starts and -1 where it
ends. Control strings inside a text are escaped, so that the decoded string is unambiguous, too.

Template: ``<s>`` opens a conversation; a user turn is ``[INST]text[/INST]``, an assistant turn is
``text</s>``, any other role is ``<<ROLE>>role<<TEXT>>text<<END>>``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<<TEXT>>", "<<END>>")
BOS, EOS, USER, USER_END, ROLE, TEXT, END = range(len(CONTROLS))

# A control string with any number of backslashes behind its first character.
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in CONTROLS))
_ENCODINGS: dict[tuple[str, str], object] = {}


def escape(text: str) -> str:
    """One more backslash behind the first character of everything that could be a control string."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _PLAIN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def encoding(ranks_file: str, pattern: str):
    """A byte-level encoding: decoding what it encoded gives the same text."""
    import tiktoken

    key = (ranks_file, pattern)
    if key not in _ENCODINGS:
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _ENCODINGS[key] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def first_reserved(ranks_file: str, pattern: str) -> int:
    return encoding(ranks_file, pattern).max_token_value + 1


SEGMENTS = "conv_id {id}, turn_index long, start long, ids array<int>, loss array<boolean>, chars long"


def format_chats(conversations: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Token ids and loss mask of every turn.

    Input: ``conv_id, turn, role, text``; other columns are not read. Returns per turn ``conv_id,
    turn_index`` (from 0 in its conversation), ``start`` (ids of the conversation before it),
    ``ids, loss`` and ``chars`` (code points of its formatted text). A conversation stands in one
    partition, in order, and is streamed: a conversation of any length takes constant memory.

    Turns are ordered by ``turn, role, text``, nulls first; repeated rows are repeated turns. A null
    text or role is empty; a null id is a conversation. No rows give no rows.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_file, pattern)
        base = enc.max_token_value + 1
        control = [np.array([base + i], dtype=np.int32) for i in range(len(CONTROLS))]
        current, turn, before = object(), 0, 0
        for batch in batches:
            names = batch.column("conv_id").to_pylist()
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            segments: list[np.ndarray] = []
            losses: list[bool] = []
            sizes, turns, chars, opens = [], [], [], []
            for name, role, text in zip(names, roles, texts, strict=True):
                role, text = role or "", escape(text or "")
                opens.append(name != current)
                turn = 0 if name != current else turn + 1
                current = name
                content = np.array(enc.encode_ordinary(text), dtype=np.int32)
                if role == "user":
                    parts, assistant = [control[USER], content, control[USER_END]], False
                    n = len(CONTROLS[USER]) + len(text) + len(CONTROLS[USER_END])
                elif role == "assistant":
                    parts, assistant = [content, control[EOS]], True
                    n = len(text) + len(CONTROLS[EOS])
                else:
                    role = escape(role)
                    who = np.array(enc.encode_ordinary(role), dtype=np.int32)
                    parts, assistant = [control[ROLE], who, control[TEXT], content, control[END]], False
                    n = len(role) + len(text) + sum(len(CONTROLS[i]) for i in (ROLE, TEXT, END))
                if turn == 0:
                    parts, n = [control[BOS], *parts], n + len(CONTROLS[BOS])
                segments += parts
                losses += [assistant and part is content for part in parts]
                sizes.append(sum(map(len, parts)))
                turns.append(turn)
                chars.append(n)
            lengths = np.array([len(s) for s in segments], dtype=np.int64)
            ends = np.cumsum(lengths)
            steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
            loss = np.array(losses, dtype=bool)
            np.add.at(steps, (ends - lengths)[loss], 1)
            np.add.at(steps, ends[loss], -1)
            mask = np.cumsum(steps)[:-1] > 0
            size = np.array(sizes, dtype=np.int64)
            upto = np.cumsum(size)
            # Ids of the conversation before each turn: prefix sums, less those at its opening.
            opened = np.array(opens, dtype=bool)
            level = np.where(opened, upto - size, 0)
            starts = upto - size - np.maximum.accumulate(level) + np.where(np.cumsum(opened) == 0, before, 0)
            before = int(starts[-1] + size[-1]) if len(size) else before
            offsets = pa.array(np.concatenate([[0], upto]).astype(np.int32))
            ids = np.concatenate(segments) if segments else np.zeros(0, np.int32)
            yield pa.record_batch(
                [
                    batch.column("conv_id"),
                    pa.array(turns, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(mask)),
                    pa.array(chars, pa.int64()),
                ],
                names=["conv_id", "turn_index", "start", "ids", "loss", "chars"],
            )

    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(assemble, SEGMENTS.format(id=kind))
    )


def read_turn(ids: np.ndarray, enc) -> tuple[str, str]:
    """Role and text of a turn, from its ids alone."""
    base = enc.max_token_value + 1
    at = np.flatnonzero(ids >= base)
    kinds = (ids[at] - base).tolist()
    if kinds and kinds[0] == BOS:
        ids, at, kinds = ids[1:], at[1:] - 1, kinds[1:]

    def text(a: int, b: int) -> str:
        return unescape(enc.decode_bytes(ids[a:b].tolist()).decode())

    if kinds == [USER, USER_END]:
        return "user", text(at[0] + 1, at[1])
    if kinds == [EOS]:
        return "assistant", text(0, at[0])
    if kinds == [ROLE, TEXT, END]:
        return text(at[0] + 1, at[1]), text(at[1] + 1, at[2])
    raise ValueError(f"not a turn: {kinds}")


def digest_chats(segments: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Per conversation, read back from the rows of :func:`format_chats` (in their order): ``conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    import hashlib

    kind = segments.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_file, pattern)
        current, state, position = None, None, 0

        def closed() -> list:
            n, whole, loss_n, loss, chars = state
            return [current, n, whole.hexdigest(), loss_n, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            ids_column, loss_column = batch.column("ids"), batch.column("loss")
            flat, bounds = ids_column.flatten().to_numpy(), np.diff(ids_column.offsets.to_numpy())
            bounds = np.concatenate([[0], np.cumsum(bounds)])
            mask = loss_column.flatten().to_numpy(zero_copy_only=False)
            names, turns = batch.column("conv_id").to_pylist(), batch.column("turn_index").to_pylist()
            starts, chars = batch.column("start").to_pylist(), batch.column("chars").to_pylist()
            for i, name in enumerate(names):
                ids, lossy = flat[bounds[i] : bounds[i + 1]], mask[bounds[i] : bounds[i + 1]]
                if turns[i] == 0:
                    if state is not None:
                        done.append(closed())
                    current, state, position = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if starts[i] != position:
                    raise ValueError("turns out of order")
                position += len(ids)
                role, text = read_turn(ids, enc)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(enc.decode_bytes(ids[lossy].tolist()).decode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars[i]
            if done:
                yield _digests(done, batch.schema.field("conv_id").type)
        if state is not None:
            yield _digests([closed()], batch.schema.field("conv_id").type)

    return segments.mapInArrow(
        digest,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _digests(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
