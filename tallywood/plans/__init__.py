"""The registered queries: importing this package, or any module of it, registers them all."""

from . import commit_graphs, graphs, guards, histories, links, map_files, matches, prose, registry, rest, scans, snapshots, source_trees, trees  # noqa: F401
