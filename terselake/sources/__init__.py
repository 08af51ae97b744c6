"""Sources and sinks: replay logs, session files, hook events, captures."""
