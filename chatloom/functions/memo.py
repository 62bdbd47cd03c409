"""Functions that remember their results, inside Python workers too."""


class remembered:
    """A function that remembers its results, at most ``most`` of them. The caches of functools are pickled by name, and executors
    have no copy of this package to look the name up in; this one travels with the function, empty."""

    def __init__(self, of, most: int | None = None):
        self.of, self.most, self.known = of, most, {}

    def __call__(self, *args):
        if args in self.known:
            return self.known[args]
        if self.most is not None and len(self.known) >= self.most:
            self.known.clear()
        out = self.known[args] = self.of(*args)
        return out

    def __getstate__(self):
        return self.__dict__ | {"known": {}}
