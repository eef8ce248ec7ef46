"""In-memory forms of an artifact's data, and the hints that ask for them."""

from __future__ import annotations

import datetime
from typing import Annotated, Any, get_args, get_origin

from pyspark.sql import DataFrame

from weft import types

#: View by Python type; a view of higher priority replaces one of lower.
_VIEWS: dict[type, tuple[int, type[View]]] = {}


class View:
    """What readers give and writers take."""

    python: type

    @classmethod
    def represents(cls, t: types.Type) -> bool:
        """Whether data of the type can have this form."""
        raise NotImplementedError


def register(python: type, view: type[View], priority: int = 0) -> None:
    found = _VIEWS.get(python)
    if found and found[0] == priority and found[1] is not view:
        raise ValueError(f"two views of {python.__name__} have priority {priority}")
    if not found or priority > found[0]:
        _VIEWS[python] = (priority, view)


def _python(kind: type, *fitting: type[types.Type]) -> type[View]:
    view = type(f"{kind.__name__.capitalize()}View", (PythonView,), {"python": kind, "fitting": fitting})
    register(kind, view)
    return view


class PythonView(View):
    """Plain values. They come to the driver, so they are for small data."""

    fitting: tuple[type[types.Type], ...]

    @classmethod
    def represents(cls, t: types.Type) -> bool:
        t = t.type if isinstance(t, types.Enum) else t
        return isinstance(t, cls.fitting) or (isinstance(t, types.Null) and cls.python is type(None))


_INTS = tuple(getattr(types, f"{k}Int{n}".replace("SInt", "Int")) for k in ("S", "U") for n in (8, 16, 32, 64))
Bool = _python(bool, types.Boolean)
Dates = _python(datetime.date, types.Date)
DateTimes = _python(datetime.datetime, types.Timestamp)
Dict = _python(dict, types.Map, types.Struct)
Float = _python(float, types.Float16, types.Float32, types.Float64)
Int = _python(int, *_INTS)
ListOf = _python(list, types.List)
NoneOf = _python(type(None), types.Null)
Str = _python(str, types.String)


class FrameView(View):
    """A Spark DataFrame: the form for tables of any size."""

    python = DataFrame

    @classmethod
    def represents(cls, t: types.Type) -> bool:
        return isinstance(t, types.Collection)


register(DataFrame, FrameView)

try:
    import pandas as pd
except ImportError:  # an optional form
    pd = None
else:

    class PandasView(View):
        """A pandas DataFrame on the driver."""

        python = pd.DataFrame

        @classmethod
        def represents(cls, t: types.Type) -> bool:
            return isinstance(t, types.Collection)

    register(pd.DataFrame, PandasView)


def view_for(hint: Any) -> type[View]:
    """The view that a hint asks for: one named in Annotated, else that of the Python type, else that of its origin."""
    if get_origin(hint) is Annotated:
        inner, *notes = get_args(hint)
        named = [n for n in notes if isinstance(n, type) and issubclass(n, View)]
        if len(named) > 1:
            raise ValueError(f"{hint} names more than one view")
        return named[0] if named else view_for(inner)
    if isinstance(hint, type) and issubclass(hint, View):
        return hint
    kind = get_origin(hint) or hint
    if kind is None:
        kind = type(None)
    if isinstance(kind, type):
        for base in kind.__mro__:
            if base in _VIEWS:
                return _VIEWS[base][1]
    raise TypeError(f"no view for {hint!r}")


def check(view: type[View], t: types.Type) -> None:
    if not view.represents(t):
        raise TypeError(f"{view.__name__} can't represent a {t.friendly_key}")
