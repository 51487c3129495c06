"""Language-model stages behind one callable.

A provider maps (system, user) texts to an answer.  The default is a rule-based stand-in that answers every stage from
its own prompt, needs no network and gives the same answer each time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from pathlib import Path

Provider = Callable[[str, str], str]
FINAL = frozenset({400, 401, 403, 404, 422})  #: HTTP answers that no retry changes


def load_config(folder: str = ".", env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of .env or .env.txt under the environment's own values, which win."""
    out: dict[str, str] = {}
    for name in (".env", ".env.txt"):
        path = Path(folder, name)
        if path.is_file():
            for line in path.read_text(encoding="utf-8").splitlines():
                key, sign, value = line.strip().partition("=")
                if sign and key and not key.startswith("#"):
                    out.setdefault(key.strip(), value.strip().strip("'\""))
    return out | dict(os.environ if env is None else env)


class ProviderError(Exception):
    def __init__(self, status: int | None, text: str) -> None:
        super().__init__(text)
        self.status = status


def with_retries(primary: Provider, fallback: Provider | None = None, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> Provider:
    """Each model up to ``tries`` times with waits of 1, 2, 4 ... seconds; then the fallback.  Final answers are not repeated."""
    def call(system: str, user: str) -> str:
        last: Exception | None = None
        for model in filter(None, (primary, fallback)):
            for attempt in range(1, tries + 1):
                try:
                    return model(system, user)
                except ProviderError as error:
                    last = error
                    if error.status in FINAL:
                        raise
                    if attempt < tries:
                        wait(2.0 ** (attempt - 1))
        raise last or ProviderError(None, "no model")

    return call


def journaled(provider: Provider, folder: str) -> Provider:
    """``provider`` with a journal of its answers in a folder that all executors share (a path or URI).

    An answer is kept under the hash of its prompt as soon as it is there, and looked up before a call: a task that is
    run again, or at the same time elsewhere, repeats no call that has ended.  The record is written beside its place and
    moved there, so none is ever read half-written.
    """
    def call(system: str, user: str) -> str:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        key = hashlib.sha256(f"{len(system)}:{system}{user}".encode()).hexdigest()
        place = f"{root}/{key[:2]}/{key}"
        if there.get_file_info(place).type == fs.FileType.File:
            with there.open_input_stream(place) as f:
                return f.read().decode()
        answer = provider(system, user)
        there.create_dir(f"{root}/{key[:2]}", recursive=True)
        draft = f"{place}.{uuid.uuid4().hex}"
        with there.open_output_stream(draft) as f:
            f.write(answer.encode())
        there.move(draft, place)
        return answer

    return call


def chat(url: str, key: str, model: str, temperature: float = 1.0, max_tokens: int = 8000, timeout: float = 120.0) -> Provider:
    """A chat-completions endpoint."""
    def call(system: str, user: str) -> str:
        body = {"model": model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as error:
            raise ProviderError(error.code, str(error)) from error
        except (OSError, KeyError, ValueError) as error:
            raise ProviderError(None, str(error)) from error

    return call


# Words of a question that name a type of entity.
TYPE_TERMS = {
    "mining_refinery": ("mine", "mines", "refinery", "smelter"), "government_ministry": ("ministry", "ministries"), "government_agency": ("agency", "agencies", "regulator", "regulates"),
    "academic_institution": ("university", "universities", "institute"), "infrastructure_node": ("power", "railway", "port", "dam"), "commodity": ("commodity", "commodities", "mineral"),
    "policy_framework": ("law", "laws", "act", "policy"), "private_conglomerate": ("company", "companies", "group"),
}


def _names(text: str) -> list[str]:
    """Runs of capitalised words that do not begin the text."""
    return list(dict.fromkeys(m for m in re.findall(r"(?<=[a-z,;] )(?:[A-Z][\w&-]*)(?: [A-Z][\w&-]*)*", text)))


def rule_based(system: str, user: str) -> str:
    """Answers for the stages that plans.pipelines names in the first line of their system texts."""
    stage = system.split("\n", 1)[0].strip()
    ids = list(dict.fromkeys(re.findall(r"^(?:NODE_ID: |=== SOURCE NODE: |--- NODE: )(.*?)(?: ===| ---)?$", user, re.M)))
    if stage == "intent":
        low = set(re.findall(r"[a-z]+", user.lower()))
        types = [k for k, words in TYPE_TERMS.items() if low & set(words)]
        kind = "COMPARISON" if low & {"compare", "versus"} else "RELATIONSHIP" if low & {"regulates", "owns", "funds", "operates"} else "FILTERED_LIST" if low & {"list", "which"} else "SPECIFIC_ENTITY" if _names(user) else "OVERVIEW"
        return json.dumps({"intent_type": kind, "target_entities": _names(user), "target_entity_types": types, "target_countries": [], "target_sectors": [], "target_attributes": {}})
    if stage == "ranking":
        return json.dumps({"ranked_nodes": [{"node_id": i, "relevance_score": 10.0 - n * 0.1, "reasoning": "order of the scores"} for n, i in enumerate(ids[:20])]})
    if stage == "synthesis":
        return json.dumps({
            "executive_summary": f"{len(ids)} notes answer the question.", "structured_intelligence": [{"entity": i, "source_node": i} for i in ids],
            "findings": [{"text": f"{i} is relevant.", "source_nodes": [i]} for i in ids[:5]], "opportunities": [], "risks": [],
            "key_entities": [{"entity_name": i, "source_node": i} for i in ids[:5]]})
    if stage == "entities":
        return json.dumps({"entities": [{"name": n, "class": "[PRIVATE_CONGLOMERATE]"} for n in _names(user)[:20]], "core_event": user.strip().split("\n", 1)[0][:200]})
    if stage == "constraints":
        return "# Constraints\n" + "\n".join(f"- {n}" for n in _names(user)[:20])
    if stage == "dashboard":
        missing = _names(user)[:3]
        return json.dumps({"intelligence_id": "INT-001", "trigger_event": user.strip().split("\n", 1)[0][:200], "market_equilibrium_shift": "", "opportunities": [
            {"opportunity_id": "OPP-001", "title": missing[0] if missing else "None", "type": "", "urgency_score": 0.5, "feasibility_score": 0.5, "required_missing_nodes": missing,
             "capital_flow": {"beneficiary": "", "likely_funder": ""}, "justification": ""}]})
    if stage == "map":
        traces = [{"source_node": i, "target_concept": "opportunity", "relationship_type": "supports", "extracted_fact": i, "logic_justification": "shared terms"} for i in ids]
        return f"<chunk_summary>{', '.join(ids)}</chunk_summary><lineage_traces>{json.dumps(traces)}</lineage_traces>"
    if stage == "reduce":
        graph = {"metrics": {"nodes_extracted": len(ids)}, "convergence_flow": {"tier_1_anchors": ids[:5], "tier_2_processing_chunks": [], "tier_3_synthesis_logic": ""}}
        return f"<final_roadmap>{user.strip()}</final_roadmap><ui_thinking_graph>{json.dumps(graph)}</ui_thinking_graph>"
    return "{}"
