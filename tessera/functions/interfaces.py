"""What kind of program a set of documents describes, and the role of each symbol in it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (label, pattern) by class, in the order in which they count as evidence; case is ignored.
GUI = (
    ("Jetpack Compose", r"@Composable\b|setContent\s*\{"),
    ("Android UI", r"class\s+\w+\s*:\s*(?:Activity|AppCompatActivity|ComponentActivity)\b|findViewById\("),
    ("Java Swing", r"import\s+javax\.swing\b|new\s+JFrame\(|new\s+JButton\("),
    ("Qt Framework", r"(?:from|import)\s+(?:PyQt[56]|PySide[26])|QMainWindow\(|QApplication\(|QWidget\("),
    ("Tkinter", r"(?:from|import)\s+tkinter\b|tk\.Tk\(|tkinter\.Tk\(|ttk\.Button\("),
    ("GTK", r"gi\.repository\s+import\s+Gtk|import\s+gtk\b|gtk_window_new|GtkWindow\s*\*"),
    ("wxWidgets", r"(?:from|import)\s+wx\b|wx\.App\("),
    ("Kivy/Flet", r"(?:from|import)\s+(?:kivy|flet)\b"),
)
TUI = (
    ("curses/ncurses", r"curses|ncurses|initscr|wrefresh|addstr"),
    ("prompt_toolkit", r"prompt_toolkit|Application\(|KeyBindings"),
    ("rich TUI", r"rich\.live|rich\.layout|rich\.console\.Console"),
    ("Terminal UI lib", r"termion|crossterm|tview|blessed"),
)
CLI = (
    ("argparse", r"argparse|ArgumentParser|add_argument|parse_args"),
    ("Click", r"@click\.command|click\.option|@click\.group"),
    ("Typer", r"typer\.Typer|typer\.Option|typer\.Argument"),
    ("CLI Parser", r"getopt|docopt|picocli|CommandLine"),
    ("Command-line args", r"sys\.argv|os\.environ|\bargc\b|\bargv\b"),
    ("Python main entry", r"if\s+__name__\s*==\s*['\"]__main__['\"]"),
    ("Standard main entry", r"\bmain\s*\(\s*int\s+argc|\bmain\s*\(\s*String\s*\[\s*\]"),
)
CLASSES = {"gui": (2, GUI), "tui": (2, TUI), "cli": (3, CLI)}
CLI_PATHS, CLI_PATH_POINTS = ("/cli/", "cli.py", "_cli.", "-cli.", "cli/"), 15
MAIN_PATHS, MAIN_PATH_POINTS = ("main.py", "__main__.py"), 5
NO_FRAMEWORK = "API / Module Library"

#: Roles in English by type: (words in the name, role), the last without words.
ROLES = {
    "CLI": (
        (("main", "cli", "run", "app", "parser", "arg", "option"), "Parses CLI arguments/flags and dispatches subcommands."),
        (("output", "print", "log"), "Controls terminal standard output and error rendering."),
        ((), "Executes processing in CLI execution pipeline."),
    ),
    "TUI": (
        (("draw", "render", "screen"), "Renders terminal UI screens and manages real-time layouts."),
        (("key", "input"), "Handles keyboard navigation and terminal interaction events."),
        ((), "Manages TUI screen state and internal logic."),
    ),
    "Library": (((), "Provides public API endpoints or internal library modules."),),
}
GUI_ROLES = (
    "Manages UI state and user interaction events, bridging the View and Domain layers.",
    "Renders UI components and captures direct user inputs.",
    "Captures user clicks/events and triggers corresponding actions.",
    "Holds view-bound state data reflected in the UI interface.",
    "Supports GUI internal processing and data flow.",
)


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars that are in no group."""
    out, depth = [""], 0
    for c in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def anchors(pattern: str) -> list[str] | None:
    """Lower-case texts of which a match has one: of each alternative its longest run of letters outside of groups, else the
    anchors of its last group. None where an alternative has none."""
    out: list[str] = []
    for part in _alternatives(pattern):
        groups = re.findall(r"\(\?:([^()]*)\)", part)
        plain = re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\]|\\.", " ", part)
        runs = re.findall(r"[A-Za-z_]{2,}(?![?*])", plain)
        inner = [max(runs, key=len).lower()] if runs else anchors(groups[-1]) if groups else None
        if inner is None:
            return None
        out += inner
    return out


#: Letters that match i, k or s whatever the case, but are not these in lower case.
_ODD, _EVEN = "\u0130\u0131\u017f\u212a", "iisk"


def folded(text: Column) -> Column:
    return F.lower(F.translate(F.coalesce(text, F.lit("")), _ODD, _EVEN))


def _count(text: Column, pattern: str) -> Column:
    """Matches; the pattern runs only over texts that have one of its anchors."""
    found = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?iU)" + pattern))
    words = anchors(pattern)
    return F.when(_any(folded(text), tuple(words)), found).otherwise(0) if words else found


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[F.contains(text, F.lit(w)) for w in words])


def scores(docs: DataFrame, text: str = "text", file: str | None = None) -> DataFrame:
    """docs plus gui_score, tui_score and cli_score. One projection."""
    out, low = docs, F.lower(F.col(file)) if file else None
    for name, (weight, patterns) in CLASSES.items():
        points = sum((weight * _count(F.col(text), p) for _, p in patterns), F.lit(0))
        if name == "cli" and file:
            points = points + F.when(_any(low, CLI_PATHS), CLI_PATH_POINTS).when(_any(low, MAIN_PATHS), MAIN_PATH_POINTS).otherwise(0)
        out = out.withColumn(f"{name}_score", points.cast("long"))
    return out


def decide(gui: Column, tui: Column, cli: Column) -> Column:
    """CLI, GUI, TUI or Library from the three scores (all GUI patterns are strong evidence)."""
    return (
        F.when((cli > 0) & ((cli >= gui) | (gui == 0)), "CLI").when((gui > 0) & (gui > cli), "GUI").when((tui > 0) & (tui >= cli), "TUI").when(cli > 0, "CLI").otherwise("Library")
    )


def detect(docs: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """One row: ui_type, framework (the first label with a match, in fixed order; then the first path), the scores, has_ui.

    Matches are counted a document and summed: one aggregation over all of them.
    """
    counts = {f"{k}_{i}": F.sum(_count(F.col(text), p)) for k, (_, ps) in CLASSES.items() for i, (_, p) in enumerate(ps)}
    low = F.lower(F.col(file))
    cli_path, main_path = _any(low, CLI_PATHS), _any(low, MAIN_PATHS)
    strong = F.min(F.when(cli_path | main_path, F.struct(F.col(file).alias("f"), cli_path.alias("cli"))))
    points = F.sum(F.when(cli_path, CLI_PATH_POINTS).when(main_path, MAIN_PATH_POINTS).otherwise(0))
    row = docs.agg(*[c.alias(k) for k, c in counts.items()], points.alias("_paths"), strong.alias("_path"))
    total = lambda k: sum((CLASSES[k][0] * F.coalesce(F.col(f"{k}_{i}"), F.lit(0)) for i in range(len(CLASSES[k][1]))), F.lit(0))
    row = row.select("*", total("gui").alias("gui_score"), total("tui").alias("tui_score"), (total("cli") + F.coalesce("_paths", F.lit(0))).alias("cli_score"))
    row = row.withColumn("ui_type", decide(F.col("gui_score"), F.col("tui_score"), F.col("cli_score")))
    first = lambda k: F.coalesce(*[F.when(F.col(f"{k}_{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(CLASSES[k][1])])
    by_path = F.when(F.col("_path.cli"), F.concat(F.lit("CLI file path pattern: "), "_path.f")).otherwise(F.concat(F.lit("Main entry script: "), "_path.f"))
    framework = F.when(F.col("ui_type") == "CLI", F.coalesce(first("cli"), by_path, F.lit("CLI"))).when(F.col("ui_type") == "GUI", first("gui"))
    framework = framework.when(F.col("ui_type") == "TUI", first("tui")).otherwise(NO_FRAMEWORK)
    cols = [F.col(f"{k}_score").cast("long").alias(f"{k}_score") for k in CLASSES]
    return row.select("ui_type", framework.alias("framework"), *cols, (F.col("ui_type") != "Library").alias("has_ui"))


def role(ui_type: Column, name: Column, kind: Column, signature: Column, raw: Column) -> Column:
    """A symbol's role by the program's type and the symbol's name; in a GUI by signature, kind and text too."""
    low, sig, k = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, signature, kind))
    gui = F.when(F.contains(low, F.lit("viewmodel")) | F.contains(sig, F.lit("viewmodel")), GUI_ROLES[0])
    gui = gui.when(F.contains(F.coalesce(raw, F.lit("")), F.lit("@composable")) | F.contains(k, F.lit("view")) | F.contains(low, F.lit("screen")), GUI_ROLES[1])
    gui = gui.when(_any(low, ("click", "event", "tap")), GUI_ROLES[2]).when(_any(low, ("state", "model")), GUI_ROLES[3]).otherwise(GUI_ROLES[4])
    out = F.when(ui_type == "GUI", gui)
    for kind_of, roles in ROLES.items():
        text = F.lit(roles[-1][1])
        for words, value in reversed(roles[:-1]):
            text = F.when(_any(low, words), value).otherwise(text)
        out = out.when(ui_type == kind_of, text) if kind_of != "Library" else out.otherwise(text)
    return out
