"""Deterministic stand-ins for a text model; each reads the whole prompt."""

from __future__ import annotations

import hashlib
import json
import re

from textrec.operators.inference import Backend


def usage(prompt: str, reply: str) -> dict[str, int]:
    return {
        "prompt_tokens": len(prompt),
        "completion_tokens": len(reply),
        "total_tokens": len(prompt) + len(reply),
    }


def answers(reply_to):
    """A backend call that answers each conversation's last message with ``reply_to``."""

    def call(talks, system, max_tokens, temperature):
        replies = []
        for talk in talks:
            prompt = talk[-1]["content"]
            reply = reply_to(prompt)
            replies.append((reply, usage(prompt, reply)))
        return replies

    return call


def digest(prompt: str) -> str:
    return hashlib.md5(prompt.encode("utf-8")).hexdigest()


def instructed_digest(talks, system, max_tokens, temperature):
    """Digest of the system prompt, the settings and the prompt."""
    replies = []
    for talk in talks:
        prompt = talk[-1]["content"]
        head = system if system is not None else talk[0]["content"]
        reply = f"{digest(f'{head}|{max_tokens}|{temperature}|{prompt}')}"
        replies.append((reply, usage(prompt, reply)))
    return replies


def moody(talks, system, max_tokens, temperature):
    """Fails on prompts of odd length and says nothing to those divisible by four."""
    replies = []
    for talk in talks:
        prompt = talk[-1]["content"]
        if len(prompt) % 2:
            raise RuntimeError("odd")
        reply = "" if len(prompt) % 4 == 0 else digest(prompt)
        replies.append((reply, usage(prompt, reply)))
    return replies


PARAGRAPH = re.compile(r"\[Source: (.*), Page (\d+)\]\n(.*)")


def find(prompt: str) -> str:
    """One finding per paragraph, on the question its length points to."""
    found = [
        {"question_num": len(text) % 5, "quote": text, "source": source, "page": int(page), "summary": digest(text)}
        for source, page, text in PARAGRAPH.findall(prompt)
    ]
    return "Here it is: " + json.dumps({"findings": found}, ensure_ascii=False) + " That is all."


def cluster(prompt: str) -> str:
    """Findings by page, three themes at most; themes by name, with their numbers of findings added up."""
    start, end = prompt.index("\n[{") + 1, prompt.index("}]\n") + 2
    themes: dict[str, list[tuple[int, int, str]]] = {}
    for at, entry in enumerate(json.loads(prompt[start:end])):
        name = entry["theme"] if "theme" in entry else f"theme {entry['page'] % 3}"
        quote = entry["key_quotes"][0] if "theme" in entry else entry["quote"]
        themes.setdefault(name, []).append((at, entry.get("findings", 1), quote))
    clusters = [
        {
            "theme": name,
            "summary": f"{sum(n for _, n, _ in members)} findings",
            "finding_indices": [at for at, _, _ in members],
            "key_quotes": [members[0][2]],
        }
        for name, members in sorted(themes.items())
    ]
    return json.dumps({"clusters": clusters}, ensure_ascii=False)


def grade(prompt: str) -> str:
    """Compares the two marked parts of the prompt."""
    answer, fact = re.search(r"Answer: (.*)\nFact: (.*)$", prompt, re.DOTALL).groups()
    return "I think so.\nGRADE: C" if fact in answer else "GRADE: I"


BACKENDS = {
    "digest": Backend(answers(digest)),
    "instructed": Backend(instructed_digest),
    "instructed_inline": Backend(instructed_digest, inline_system=True),
    "moody": Backend(moody),
    "find": Backend(answers(find)),
    "cluster": Backend(answers(cluster)),
    "grade": Backend(answers(grade)),
}
