"""Command line: index, search, ask, chat, setup, doctor, reset."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from siftspark import __version__, models
from siftspark.config import Config, default_file
from siftspark.operators import rag


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftspark")
    top.add_argument("-V", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, query: bool = False, k: bool = False, model: bool = False, auto: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if query:
            p.add_argument("query")
        p.add_argument("-p", "--path", default=".")
        if k:
            p.add_argument("-k", "--top-k", type=int)
        if model:
            p.add_argument("-m", "--model")
        if auto:
            p.add_argument("--auto-index", action=argparse.BooleanOptionalAction, default=None)
        return p

    p = sub.add_parser("index")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--rebuild", action="store_true")
    p = command("search", query=True, k=True, auto=True)
    p.add_argument("--summary", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--code", action=argparse.BooleanOptionalAction, default=True)
    p = command("ask", query=True, k=True, model=True, auto=True)
    p.add_argument("--no-llm", action="store_true")
    command("chat", k=True, model=True)
    p = command("setup", model=True)
    p.add_argument("--tier")
    p.add_argument("-y", "--yes", action="store_true")
    p.add_argument("--pull", action=argparse.BooleanOptionalAction, default=None)
    p = command("doctor")
    p.add_argument("--write-config", action="store_true")
    p.add_argument("--pull", action="store_true")
    p = command("reset")
    p.add_argument("-y", "--yes", action="store_true")
    return top


def _ensure_index(engine, auto: bool | None, out) -> bool:
    """True: there is an index. auto None asks on a terminal and builds elsewhere."""
    if engine.exists():
        return True
    if auto is False:
        print("No index found. Run: siftspark index", file=out)
        return False
    if auto is None and sys.stdin.isatty() and input("No index found. Build it now? [Y/n] ").strip().lower() in ("n", "no"):
        return False
    engine.index()
    return True


def _print_hits(rows, code: bool, out) -> None:
    for r in rows:
        print(f"{r['position']}. {r['rel_path']}:{r['start_line']}-{r['end_line']}  [{r['label']}]", file=out)
        if code:
            print(r["snippet"] + "\n", file=out)


def _generator(cfg, model: str | None):
    """A generator if the model server answers and has the model, else None."""
    wanted = model or cfg.model
    if not rag.model_available(rag.server_models(cfg.llm_base_url), wanted):
        return None
    return rag.http_generator(cfg.llm_base_url, wanted, cfg.llm_temperature, cfg.llm_num_ctx)


def parse_slash(line: str, k: int, model: str) -> tuple[str, int, str]:
    """(action, k, model) of a chat command: exit, help, clear, set or unknown."""
    word, _, rest = line.strip().partition(" ")
    if word in ("/exit", "/quit", "/q"):
        return "exit", k, model
    if word in ("/help", "/h", "/?"):
        return "help", k, model
    if word == "/clear":
        return "clear", k, model
    if word == "/k":
        try:
            return "set", max(1, int(rest)), model
        except ValueError:
            return "unknown", k, model
    if word == "/model" and rest.strip():
        return "set", k, rest.strip()
    return "unknown", k, model


def main(argv: list[str] | None = None, *, spark=None, generator: Callable | None = None, out=None) -> int:
    """Exit codes: 0 fine (also without matches), 1 no index or refused, 2 model not ready, 3 generation failed."""
    args = _parser().parse_args(argv)
    out = out or sys.stdout
    cfg = Config.from_file()
    from siftspark.plans.engine import Engine
    from siftspark.session import build_session

    spark = spark or build_session()
    engine = Engine(spark, args.path, cfg)
    ready = lambda: generator or _generator(cfg, getattr(args, "model", None))
    if args.command == "index":
        for name, n in engine.index(rebuild=args.rebuild, progress=lambda phase: print(f"... {phase}", file=out)).items():
            print(f"{name}: {n}", file=out)
        return 0
    if args.command == "setup":
        return _setup(engine, args, cfg, out)
    if args.command == "doctor":
        return _doctor(engine, args, cfg, out)
    if args.command == "reset":
        if not args.yes and (not sys.stdin.isatty() or input("Delete the index? [y/N] ").strip().lower() not in ("y", "yes")):
            return 1
        engine.destroy()
        return 0
    if not _ensure_index(engine, getattr(args, "auto_index", None), out):
        return 1
    if args.command == "chat":
        return _chat(engine, args, ready, out)
    hits = engine.snippets(engine.search(args.query, args.top_k)).orderBy("position")
    rows = hits.collect()  # at most k hits of one query
    if not rows:
        print("No matches.", file=out)
        return 0
    if args.command == "search":
        generate = ready() if args.summary else None
        if generate is None:
            _print_hits(rows, args.code, out)
            if args.summary:
                print("Tip: run setup and start a model server for answers.", file=out)
            return 0
    elif args.no_llm:
        _print_hits(rows, True, out)
        return 0
    else:
        generate = ready()
        if generate is None:
            print("The model server is not ready.", file=out)
            return 2
    return _answer(engine, rag.Conversation(generate), args.query, hits, rows, out)


def _setup(engine, args, cfg, out) -> int:
    """Keep a model's name, download it if wanted. 1: unknown tier, 2: a download asked for by --pull or begun did not end well."""
    ask = sys.stdin.isatty() and not args.yes
    name = args.model
    if not name:
        try:
            tier = models.resolve(args.tier) if args.tier else None
        except ValueError as problem:
            print(problem, file=out)
            return 1
        if tier is None:
            size = engine.project_stats()
            tier = size["tier"]
            print(f"{size['file_count']} files, {size['total_loc']} lines\n{models.table(tier)}", file=out)
            if ask and (typed := input(f"Which one? [{tier}] ").strip()):
                try:
                    tier = models.resolve(typed)
                except ValueError as problem:
                    print(problem, file=out)
                    return 1
        name = models.CHOICES[tier].model
    print(f"model = {name}, kept in {Config.save(model=name)}", file=out)
    pull = args.pull
    if pull is None:
        pull = args.yes or ask and input(f"Download {name} now? [Y/n] ").strip().lower() not in ("n", "no")
    if not pull:
        return 0
    have = rag.server_models(cfg.llm_base_url)
    if have is None:
        print(f"No model server answers at {cfg.llm_base_url}; start one and run setup --pull.", file=out)
        return 2 if args.pull else 0
    return 0 if rag.model_available(have, name) or _fetched(cfg, name, out) else 2


def _fetched(cfg, name: str, out) -> bool:
    try:
        rag.fetch_model(cfg.llm_base_url, name)
    except (OSError, ValueError) as problem:
        print(f"{name} was not downloaded: {problem}", file=out)
        return False
    print(f"{name} is there.", file=out)
    return True


def _doctor(engine, args, cfg, out) -> int:
    """Four lines: settings, model server, model, index. Always 0: it reports."""
    if args.write_config and not default_file().exists():
        Config.save(**cfg.all())
    have = rag.server_models(cfg.llm_base_url)
    there = rag.model_available(have, cfg.model) or bool(args.pull and have is not None and _fetched(cfg, cfg.model, out))
    print(f"settings: {default_file()}{'' if default_file().exists() else ' (defaults)'}", file=out)
    print(f"model server: {cfg.llm_base_url} {'answers' if have is not None else 'does not answer'}", file=out)
    print(f"model: {cfg.model} {'is there' if there else 'is missing'}", file=out)
    print(f"index: {engine.chunks().count()} chunks" if engine.exists() else "index: none", file=out)
    return 0


def _answer(engine, talk, query: str, hits, rows, out) -> int:
    context = engine.context(hits).first()
    print("Answer", file=out)
    try:
        for piece in talk.ask(query, context["context"] if context else ""):
            print(piece, end="", file=out)
    except Exception as problem:  # noqa: BLE001 - a broken stream ends the answer
        print(f"\nGeneration failed: {problem}", file=out)
        return 3
    print("\nSources: " + ", ".join(f"{r['rel_path']}:{r['start_line']}-{r['end_line']}" for r in rows), file=out)
    return 0


def _chat(engine, args, ready, out) -> int:
    generate = ready()
    if generate is None:
        print("The model server is not ready.", file=out)
        return 2
    talk, k, model = rag.Conversation(generate, engine.cfg.history_messages), engine.cfg.k(args.top_k), args.model or engine.cfg.model
    for line in sys.stdin:
        line = line.strip()
        if line.startswith("/"):
            action, k, chosen = parse_slash(line, k, model)
            if action == "exit":
                break
            if action == "clear":
                talk.clear()
            elif action in ("help", "unknown"):
                print("/exit  /help  /clear  /k N  /model NAME", file=out)
            elif chosen != model:
                model, args.model = chosen, chosen
                talk.generate = ready() or talk.generate
        elif line:
            hits = engine.snippets(engine.search(line, k)).orderBy("position")
            rows = hits.collect()  # at most k hits
            if rows:
                _answer(engine, talk, line, hits, rows, out)
            else:
                print("No matches.", file=out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
