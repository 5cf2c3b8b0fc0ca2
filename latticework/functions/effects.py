"""What has effects: names of builtins, methods and library functions, and how a call by them is judged."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Builtins with effects.
IMPURE_BUILTINS = ("print", "open", "input", "exec", "eval", "compile", "breakpoint", "exit", "quit", "help")
#: Methods with effects on any receiver.
IO_METHODS = (
    "write_text", "write_bytes", "read_text", "read_bytes", "unlink", "rmdir", "touch", "chmod", "write", "writelines", "read",
    "readline", "readlines", "flush", "truncate", "recv", "recvfrom", "system", "popen", "spawn", "mkdir", "makedirs", "rename",
    "chown", "symlink",
)
#: Methods that change their receiver.
MUTATORS = ("append", "extend", "insert", "pop", "clear", "update", "setdefault", "sort", "reverse", "add", "discard", "popitem", "remove")
#: Library functions with effects, or with results that aren't determined.
IMPURE_FUNCTIONS = (
    "os.system", "os.popen", "os.spawn", "os.spawnl", "os.spawnv", "os.exec", "os.execl", "os.execv", "os.execve",
    "os.remove", "os.unlink", "os.rmdir", "os.removedirs", "os.mkdir", "os.makedirs", "os.rename", "os.renames", "os.replace",
    "os.chdir", "os.chmod", "os.chown", "os.symlink", "os.link", "os.truncate", "os.utime", "os.write", "os.read",
    "os.kill", "os.killpg", "os.fork", "os.wait", "os.waitpid", "os.environ.pop", "os.environ.update",
    "os.path.exists", "os.path.isfile", "os.path.isdir",
    "subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.Popen",
    "subprocess.getoutput", "subprocess.getstatusoutput",
    "shutil.copy", "shutil.copy2", "shutil.copyfile", "shutil.copytree", "shutil.move", "shutil.rmtree", "shutil.chown",
    "tempfile.mkstemp", "tempfile.mkdtemp", "tempfile.NamedTemporaryFile", "tempfile.TemporaryFile", "tempfile.TemporaryDirectory",
    "time.time", "time.monotonic", "time.perf_counter", "time.process_time", "time.sleep", "time.localtime", "time.gmtime",
    "random.random", "random.randint", "random.choice", "random.shuffle", "random.uniform", "random.sample", "random.seed",
    "secrets.token_bytes", "secrets.token_hex", "secrets.token_urlsafe", "secrets.choice",
    "datetime.datetime.now", "datetime.datetime.today", "datetime.datetime.utcnow", "datetime.date.today",
    "socket.socket", "socket.create_connection",
    "requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "requests.request",
    "urllib.request.urlopen", "urllib.request.urlretrieve", "http.client.HTTPConnection", "http.client.HTTPSConnection",
    "logging.info", "logging.debug", "logging.warning", "logging.error", "logging.critical", "logging.exception", "logging.log",
    "warnings.warn",
    "pathlib.Path.write_text", "pathlib.Path.write_bytes", "pathlib.Path.read_text", "pathlib.Path.read_bytes", "pathlib.Path.unlink",
    "pathlib.Path.mkdir", "pathlib.Path.rmdir", "pathlib.Path.touch", "pathlib.Path.rename", "pathlib.Path.replace",
    "pathlib.Path.chmod", "pathlib.Path.symlink_to", "pathlib.Path.hardlink_to", "pathlib.Path.open",
)
#: Methods with effects on receivers of a known type, and types whose methods have none.
STREAM = ("write", "writelines", "read", "readline", "readlines", "flush", "close", "truncate", "seek")
IMPURE_METHODS = {
    "Path": (
        "write_text", "write_bytes", "read_text", "read_bytes", "unlink", "rmdir", "mkdir", "touch", "chmod", "chown", "rename",
        "replace", "symlink_to", "hardlink_to", "open", "iterdir", "glob", "rglob", "stat", "lstat", "exists", "is_file", "is_dir",
        "is_symlink", "is_socket", "resolve", "samefile", "readlink",
    ),
    "IO": STREAM,
    "TextIO": STREAM,
    "BinaryIO": STREAM,
    "Logger": ("debug", "info", "warning", "error", "critical", "exception", "log"),
}
IMMUTABLE_TYPES = ("str", "bytes", "int", "float", "bool", "complex", "tuple", "frozenset", "NoneType")


@dataclass(frozen=True)
class Policy:
    """What counts as an effect."""

    builtins: tuple[str, ...] = IMPURE_BUILTINS
    functions: tuple[str, ...] = IMPURE_FUNCTIONS
    io_methods: tuple[str, ...] = IO_METHODS
    mutators: tuple[str, ...] = MUTATORS
    typed: dict[str, tuple[str, ...]] = field(default_factory=lambda: IMPURE_METHODS)

    def extended(self, builtins: Iterable[str] = (), functions: Iterable[str] = (), io_methods: Iterable[str] = (), allow: Iterable[str] = ()) -> Policy:
        """With more names, and without those that are allowed, whatever list they are in."""
        allowed = set(allow)
        less = lambda names, more=(): tuple(n for n in dict.fromkeys((*names, *more)) if n not in allowed)
        return Policy(less(self.builtins, builtins), less(self.functions, functions), less(self.io_methods, io_methods), less(self.mutators), {t: less(m) for t, m in self.typed.items()})


def impure_method(method: Column, receiver_type: Column, receiver_kind: Column, policy: Policy | None = None) -> Column:
    """Whether a call of a method has effects: by the receiver's type where that says, else any tracked method of a parameter, else methods of input and output."""
    policy = policy or Policy()
    tracked = method.isin(*policy.io_methods, *policy.mutators, *(m for methods in policy.typed.values() for m in methods))
    out = F.when(receiver_type.isin(*IMMUTABLE_TYPES), False)
    for name, methods in policy.typed.items():
        out = out.when(receiver_type == name, method.isin(*methods))
    return F.coalesce(out.when(receiver_kind == "parameter", tracked).otherwise(method.isin(*policy.io_methods)), F.lit(False))
