"""Sources and sinks: driver tables projected onto the sensor schemas, the
measurement store verbs, weather responses and forecast files."""
