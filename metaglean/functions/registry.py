"""Format registry: built-in handlers and plugins."""

from __future__ import annotations

from typing import Protocol

from .formats import gif, isobmff, jpeg, pdf, png, raw, svg, tiff, webp

HANDLERS = {"jpeg": jpeg, "png": png, "webp": webp, "gif": gif, "svg": svg, "tiff": tiff, "heic": isobmff.still, "avif": isobmff.still, "pdf": pdf, "mp4": isobmff.video, "mov": isobmff.video, "dng": raw, "raw": raw}
MIME = {
    "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "avif": "image/avif", "heic": "image/heic", "tiff": "image/tiff",
    "raw": "image/x-raw", "dng": "image/x-adobe-dng", "mov": "video/quicktime", "mp4": "video/mp4", "pdf": "application/pdf", "unknown": "application/octet-stream",
}
DATA_URL_MIMES = sorted({*MIME.values(), "image/heif"})
EXTENSIONS = sorted("avif arw cr2 dng gif heic heif jpeg jpg m4v mov mp4 nef pdf png raw svg tif tiff webp".split())
CONFIDENCE = {"high": "avif heic jpeg png tiff webp".split(), "medium": "dng gif mov mp4 pdf raw svg".split()}


class Plugin(Protocol):
    """What a registered format offers; read may be absent."""

    def detect(self, data: bytes) -> bool: ...
    def types(self, data: bytes) -> list[str]: ...
    def remove(self, data: bytes, options) -> bytes: ...


class Registry:
    """Plugins by lower-case name; a value of its own that travels to the workers with the job."""

    def __init__(self):
        self.plugins: dict[str, Plugin] = {}

    def register(self, name: str, plugin: Plugin) -> None:
        missing = [f for f in ("detect", "types", "remove") if not callable(getattr(plugin, f, None))]
        if missing:
            raise TypeError(f"a plugin needs {', '.join(missing)}")
        self.plugins[name.lower()] = plugin

    def unregister(self, name: str) -> bool:
        return self.plugins.pop(name.lower(), None) is not None

    def names(self) -> list[str]:
        return list(self.plugins)

    def detect(self, data: bytes) -> str | None:
        for name, plugin in self.plugins.items():
            try:
                if plugin.detect(data):
                    return name
            except Exception:  # noqa: BLE001 - a broken plugin is passed over
                continue
        return None

    def handler(self, name: str):
        return HANDLERS.get(name) or self.plugins.get(name)


def supported(name: str) -> bool:
    return name in HANDLERS


def confidence(name: str) -> str:
    return next((c for c, names in CONFIDENCE.items() if name in names), "low")
