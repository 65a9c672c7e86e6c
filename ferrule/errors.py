"""What can go wrong before a rule runs."""


class ParseError(ValueError):
    """A rule definition or an expression that can't be read."""


class TypeMismatch(TypeError):
    """An expression whose parts don't fit together."""


class CompileError(RuntimeError):
    """A rule that failed at a stage: JSON parsing, AST building, type checking or lowering."""

    def __init__(self, stage: str, rule: str, cause: Exception):
        super().__init__(f"Rule '{rule}' failed at the {stage} stage: {cause}")
        self.stage, self.rule = stage, rule
