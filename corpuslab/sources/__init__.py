"""Reading and writing: case files, evaluation payloads, logs, shards, source trees and packages."""
