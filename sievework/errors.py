"""What can go wrong, by kind."""


class SieveError(Exception):
    """Any error of this library."""


class ReadError(SieveError):
    """An input that can't be read."""


class ParseError(SieveError):
    """A line that isn't a record; ``line`` is its number from 1."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


class EmptyInput(SieveError):
    """No usable record at all."""


class ConfigError(SieveError):
    """A configuration that can't be read or parsed."""


class WeightError(ConfigError):
    """Weights that aren't numbers from 0 to 1 with sum 1."""


class FormatError(SieveError):
    """An unknown output format."""


class WriteError(SieveError):
    """An output that can't be written."""


class RegistryError(SieveError):
    """A model family that is unknown or malformed."""


class ArgumentError(SieveError):
    """An argument out of its range."""
